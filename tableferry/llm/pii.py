"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs before a digit, digits,
schemes and identifier cues. Around each anchor a local parser expands to the boundaries of what
may stand there and validates it (label structure, ranges, Luhn and mod-97 sums, digit counts).
Parsers read each character a bounded number of times, so a text costs time in its length only.

Kinds ``email, ip, card, phone`` are defined by the patterns in ``BASE``; the parsers give the
leftmost, non-overlapping matches of those patterns, and drop the ones that fail validation without
another try. Kinds found from cues come on top: ``iban``, ``account`` and ``login_url`` (an address
with a user and a password in it).

Defined results: null counts as empty; empty texts have no spans; repeated rows give equal rows;
spans are code points, end exclusive, ordered by start, then kind in the order of ``KINDS``; other
columns are passed on untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import text_batches
from .text import fresh

# What a base kind is, before validation.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = (*BASE, "iban", "account", "login_url")
SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

DIGITS = frozenset("0123456789")
LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
LABEL = DIGITS | LETTERS | {"-"}
LOCAL = DIGITS | LETTERS | frozenset("._%+-")
PHONE = DIGITS | frozenset(" ().-")
URL_USER = DIGITS | LETTERS | frozenset("._%+-~!$&*")
SCHEMES = ("http://", "https://", "ftp://", "ssh://", "postgres://", "mysql://", "redis://", "amqp://")
IBAN_CUES = ("IBAN", "Iban", "iban")
ACCOUNT_CUES = ("account", "Account", "ACCOUNT", "acct", "Acct", "ACCT")
CUE_WORDS = ("number", "no", "nr", "num", "id")


@lru_cache(maxsize=1)
def _anchors() -> ahocorasick.Automaton:
    """Built once in each Python worker."""
    automaton = ahocorasick.Automaton()
    for digit in DIGITS:
        automaton.add_word(digit, ("digit", 1))
        automaton.add_word("+" + digit, ("phone", 2))
    automaton.add_word("@", ("email", 1))
    for kind, cues in (("login_url", SCHEMES), ("iban", IBAN_CUES), ("account", ACCOUNT_CUES)):
        for cue in cues:
            automaton.add_word(cue, (kind, len(cue)))
    automaton.make_automaton()
    return automaton


def _run(text: str, at: int, allowed: frozenset[str]) -> int:
    """End of the run of allowed characters that begins at a place."""
    n = len(text)
    while at < n and text[at] in allowed:
        at += 1
    return at


def _email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    start = at
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    end = _run(text, at + 1, LABEL)
    if start == at or end == at + 1:
        return None
    labels = 0
    while end + 1 < len(text) and text[end] == "." and text[end + 1] in LABEL:
        end = _run(text, end + 1, LABEL)
        labels += 1
    return (start, end) if labels else None


def _octet(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or "0") <= 255


def _addresses(text: str, at: int) -> tuple[list[tuple[int, int]], int]:
    """Dotted numbers in fours from the left, and the end of the chain of dotted numbers."""
    found, parts = [], []
    while True:
        end = _run(text, at, DIGITS)
        parts.append((at, end))
        if len(parts) == 4:
            if all(_octet(text[s:e]) for s, e in parts):
                found.append((parts[0][0], end))
            parts = []
        if end + 1 < len(text) and text[end] == "." and text[end + 1] in DIGITS:
            at = end + 1
        else:
            return found, end


def _luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(x * 2 - 9 * (x > 4) for x in map(int, digits[-2::-2]))
    return (odd + even) % 10 == 0


def _card(text: str, at: int) -> tuple[bool, int]:
    """Whether the chain of digits with single blanks or hyphens between them is a card, and its end."""
    n, end = len(text), _run(text, at, DIGITS)
    while end + 1 < n and text[end] in " -" and text[end + 1] in DIGITS:
        end = _run(text, end + 1, DIGITS)
    if end - at > 40:
        return False, end
    digits = text[at:end].replace(" ", "").replace("-", "")
    return 12 <= len(digits) <= 19 and _luhn(digits), end


def _phone(text: str, at: int) -> tuple[bool, int]:
    """Whether a number with a plus sign has a phone's digits; its end (0: no match at all)."""
    end = _run(text, at + 2, PHONE)
    while end > at + 2 and text[end - 1] not in DIGITS:
        end -= 1
    if end < at + 4:
        return False, 0
    return 9 <= sum(c in DIGITS for c in text[at:end]) <= 15, end


def _past_cue(text: str, at: int) -> int:
    """Where a value begins after a cue: past marks, blanks and one of the words such as "number"."""
    for _ in range(2):
        while at < len(text) and text[at] in " :#=.\t":
            at += 1
        word = text[at : at + 6].lower()
        found = next((w for w in CUE_WORDS if word.startswith(w) and not text[at + len(w) : at + len(w) + 1].isalnum()), "")
        at += len(found)
        if not found:
            break
    return at


def _iban(text: str, cue_end: int) -> tuple[int, int] | None:
    start = _past_cue(text, cue_end)
    best, compact = None, ""
    for at in range(start, min(start + 42, len(text))):
        c = text[at]
        if c == " ":
            continue
        if c not in DIGITS and not "A" <= c <= "Z":
            break
        compact += c
        if 15 <= len(compact) <= 34 and compact[:2].isalpha() and compact[2:4].isdigit():
            if int("".join(str(int(x, 36)) for x in compact[4:] + compact[:4])) % 97 == 1:
                best = (start, at + 1)
    return best


def _account(text: str, cue_end: int) -> tuple[int, int] | None:
    start = _past_cue(text, cue_end)
    end = _run(text, start, DIGITS)
    return (start, end) if 6 <= end - start <= 17 else None


def _login_url(text: str, cue_end: int) -> tuple[int, int] | None:
    user = _run(text, cue_end, URL_USER)
    if user == cue_end or text[user : user + 1] != ":":
        return None
    secret = _run(text, user + 1, URL_USER)
    if secret == user + 1 or text[secret : secret + 1] != "@":
        return None
    host = _run(text, secret + 1, LABEL | {"."})
    return (cue_end, host) if host > secret + 1 else None


def find(text: str) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) of one text."""
    out: list[tuple[str, int, int]] = []
    free = dict.fromkeys(("email", "ip", "card", "phone"), 0)  # where the next match of a kind may begin
    for last, (kind, length) in _anchors().iter(text):
        start = last + 1 - length
        if kind == "digit":
            if start >= free["ip"]:
                found, free["ip"] = _addresses(text, start)
                out += [("ip", s, e) for s, e in found]
            if start >= free["card"]:
                good, free["card"] = _card(text, start)
                if good:
                    out.append(("card", start, free["card"]))
        elif kind == "email":
            if span := _email(text, start, free["email"]):
                out.append(("email", *span))
                free["email"] = span[1]
        elif kind == "phone":
            if start >= free["phone"]:
                good, end = _phone(text, start)
                free["phone"] = max(end, free["phone"])
                if good:
                    out.append(("phone", start, end))
        elif span := {"iban": _iban, "account": _account, "login_url": _login_url}[kind](text, last + 1):
            out.append((kind, *span))
    out.sort(key=lambda x: (x[1], KINDS.index(x[0])))
    return out


def _spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        rows = [
            [{"kind": k, "start": s, "end": e} for k, s, e in find(text)] if text else [] for text in batch.to_pylist()
        ]
        yield pa.array(rows, SPAN)


def pii_spans(text: Column) -> Column:
    """The spans of a text column as ``array<struct<kind, start, end>>``."""

    @F.arrow_udf("array<struct<kind:string,start:int,end:int>>")
    def spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from _spans(batches)

    return spans(text)


def scanned(docs: DataFrame, text_col: str = "text", out: str = "pii") -> DataFrame:
    """``docs`` and a column of spans."""
    text_batches(docs.sparkSession)
    return docs.withColumn(fresh(docs, out), pii_spans(docs[text_col]))


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets, columns unchanged."""
    out = fresh(docs, "_pii")
    text, spans = F.col(text_col), F.col(out)
    parts = F.aggregate(
        spans,
        F.struct(F.lit("").alias("text"), F.lit(0).alias("at")),
        lambda acc, x: F.when(x["start"] < acc["at"], acc).otherwise(
            F.struct(
                F.concat(
                    acc["text"],
                    F.substring(text, acc["at"] + 1, x["start"] - acc["at"]),
                    F.lit("<"), x["kind"], F.lit(">"),
                ).alias("text"),
                x["end"].alias("at"),
            )
        ),
        lambda acc: F.concat(acc["text"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    clean = F.when((F.size(out) > 0) & text.isNotNull(), parts).otherwise(text)
    return scanned(docs, text_col, out).withColumn(text_col, clean).drop(out)
