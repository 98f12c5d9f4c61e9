"""Awkward documents, and plain reference versions of the operators."""

from __future__ import annotations

import collections
import hashlib
import re
import string

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BLANK = re.compile(r"[^\x20\x09-\x0D]+")

SENTENCE = "the quick brown fox jumps over the lazy dog and runs along the river bank to find a quiet place"
LONG = " ".join(f"word{i} of the text" for i in range(6_000))

# doc_id, text, lang, source, n_chars and two columns whose names operators use themselves
ROWS = [
    (1, SENTENCE, "en", "a", len(SENTENCE), "x", 1),
    (2, SENTENCE.upper(), "en", "a", len(SENTENCE), None, 2),
    (3, None, None, None, None, None, None),
    (4, "", "en", "a", 0, "x", 1),
    (5, "\n \t\n", "en", "b", 4, "x", 1),
    (6, "Two words", "en", None, 9, "x", 1),
    (7, LONG, "en", "a", len(LONG), "x", 1),
    (7, LONG, "en", "a", len(LONG), "x", 1),
    (None, SENTENCE, "en", "a", len(SENTENCE), "x", 1),
    (8, "größer ÄÖ 漢字 😀 é" * 3, "de", "b", 50, "x", 1),
    (9, "line one here\nline one here\n" + SENTENCE, "en", "b", 100, "x", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, Spans int"


def documents(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def same_columns(found, docs):
    """The columns of ``docs`` come back first and untouched."""
    assert found.columns[: len(docs.columns)] == docs.columns
    left = sorted(map(repr, docs.collect()))
    assert sorted(repr(r) for r in found.select(*[found[c] for c in docs.columns]).collect()) == left


def plain_words(text):
    return PLAIN.findall((text or "").translate(LOWER))


def blank_words(text):
    return BLANK.findall(text or "")


def quality(text):
    words = blank_words(text)
    grams = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if BLANK.search(x)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered),
    )


def contamination(docs, items, size=13):
    windows = collections.defaultdict(set)
    for item, text in items:
        words = plain_words(text)
        for i in range(max(1, len(words) - size + 1) if words else 0):
            windows[tuple(words[i : i + size])].add(str(item))
    sizes, out = {len(w) for w in windows}, []
    for doc, text in docs:
        words, hit, found = plain_words(text), set(), set()
        for n in sizes:
            for i in range(len(words) - n + 1):
                if own := windows.get(tuple(words[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= own
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(words), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(words)))
    return out


def groups(docs, size):
    """(set size, smallest linked id) by id, comparing every two documents."""
    sets = {}
    for doc, text in docs:
        words = BLANK.findall((text or "").translate(LOWER))
        sets[doc] = {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()
    part = {doc: doc for doc in sets}

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                part[y] = x
    return {doc: (len(sets[doc]), root(doc)) for doc in ids}
