"""SentencePiece encoding and decoding from a model file, without training and without the library's encoder.

An Aho-Corasick automaton over all pieces reads a word once; at every place its output links name
the pieces that end there, and each relaxes the best path to that place (a Viterbi pass):

- unigram models: a path's score is the sum of its pieces' scores; unknown characters cost ten less
  than the worst piece;
- BPE models: a path is admissible if each two neighbours are stable, that is, if merging their joint
  text by rank gives back exactly these two. Every prefix has one admissible path, the one that
  merging would give, so the pass finds it from left to right without merging the word. (Summing
  the ranks of such a model, as a unigram pass would, gives other pieces than its users expect.)

Unknown characters fall back to byte pieces where the model has them. Text is split into words, and
words between two characters, only where no piece of the model crosses, which is looked up in the file.
Encoded words are kept in bounded caches in each Python worker.

Defined results: null and empty texts give no ids; decoding gives back the text, but for U+2581,
which the format itself uses for blanks, and for characters the model does not know and can not
spell in bytes; repeated rows give equal rows; other columns are passed on untouched. Models that
rewrite characters (a compiled map of replacements) or trim blanks are refused.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import text_batches
from .text import fresh

BLANK = "▁"
NORMAL, UNKNOWN, USER_DEFINED, BYTE = 1, 2, 4, 6  # fixed values: kinds of pieces in the file
UNIGRAM, BPE = 1, 2  # fixed values: kinds of models in the file
UNKNOWN_COST = 10.0  # fixed value: below the worst score of a piece
CACHED_WORDS = 200_000  # in each of three caches; a worker keeps its caches while others run beside it
CACHED_PAIRS = 500_000
LONGEST_CACHED = 48


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message's fields."""
    at = 0

    def number() -> int:
        nonlocal at
        value, shift = 0, 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, data[at : at + size]
            at += size


class Tokenizer:
    """Pieces of a model file, their automaton, and encoding and decoding of single texts."""

    def __init__(self, path: str) -> None:
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.model, self.prefix = UNIGRAM, True
        with open(path, "rb") as file:
            for field, value in _fields(file.read()):
                if field == 1:
                    own = {k: v for k, v in _fields(value)}
                    self.pieces.append(own.get(1, b"").decode())
                    self.scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                    self.kinds.append(own.get(3, NORMAL))
                elif field == 2:
                    self.model = dict(_fields(value)).get(3, UNIGRAM)
                elif field == 3:
                    spec = dict(_fields(value))
                    self.prefix = bool(spec.get(3, 1))
                    if spec.get(2) or spec.get(4, 1) or not spec.get(5, 1):
                        raise ValueError("models that rewrite or trim their input are not supported")
        if self.model not in (UNIGRAM, BPE):
            raise ValueError("neither a unigram nor a BPE model")
        self._prepare()

    def _prepare(self) -> None:
        usable = [i for i, kind in enumerate(self.kinds) if kind in (NORMAL, USER_DEFINED) and self.pieces[i]]
        self.ids = {self.pieces[i]: i for i in usable}
        self.rank = {piece: -self.scores[i] for piece, i in self.ids.items()}
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        self.chars = {piece for piece in self.ids if len(piece) == 1}
        self.sizes = [len(piece) for piece in self.pieces]
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i, kind in enumerate(self.kinds) if kind == BYTE}
        self.unknown = self.kinds.index(UNKNOWN) if UNKNOWN in self.kinds else 0
        self.unknown_score = min((self.scores[i] for i in usable), default=0.0) - UNKNOWN_COST
        self.by_word = self.prefix and not any(BLANK in piece.lstrip(BLANK) for piece in self.ids)
        # no piece crosses two characters that stand together in none; an unknown piece may, where there is one
        self.inside = {piece[k : k + 2] for piece in self.ids for k in range(len(piece) - 1)}
        self.cuts = len(self.byte_ids) == 256
        self.raw = [self._bytes_of(i) for i in range(len(self.pieces))]
        self.words: dict[str, bytes] = {}  # without their blank, in two generations
        self.old_words: dict[str, bytes] = {}
        self.units: dict[str, bytes] = {}
        self.stable: list[dict[int, bool]] = [{} for _ in range(len(self.pieces) + 1)]  # the last: at the beginning
        self.stable_pairs = 0

    def _bytes_of(self, i: int) -> bytes:
        if self.kinds[i] == BYTE:
            return bytes([int(self.pieces[i][3:5], 16)])
        if self.kinds[i] == UNKNOWN:
            return " ⁇ ".encode()  # fixed value: how an unknown piece reads
        return self.pieces[i].replace(BLANK, " ").encode() if self.kinds[i] in (NORMAL, USER_DEFINED) else b""

    def _merged(self, text: str) -> list[str]:
        """Plain merging by rank; used on the text of one or two pieces only."""
        parts, rank = list(text), self.rank.get
        while True:
            ranks = [rank(a + b, np.inf) for a, b in zip(parts, parts[1:])]
            best = min(ranks, default=np.inf)
            if best == np.inf:
                return parts
            place = ranks.index(best)
            parts[place : place + 2] = [parts[place] + parts[place + 1]]

    def _stable(self, left: int, right: int) -> bool:
        """Whether merging leaves a piece (left < 0), or two neighbours, as they are."""
        known = self.stable[left].get(right)
        if known is None:
            parts = [self.pieces[right]] if left < 0 else [self.pieces[left], self.pieces[right]]
            known = self._merged("".join(parts)) == parts
            self.stable_pairs += 1
            if self.stable_pairs > CACHED_PAIRS:
                for row in self.stable:
                    row.clear()
                self.stable_pairs = 1
            self.stable[left][right] = known
        return known

    def _spelled(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode()] if len(self.byte_ids) == 256 else [self.unknown]

    def _path(self, word: str) -> list[int]:
        """Ids of one word: one pass of the automaton, relaxing the best path to each place."""
        if self.model == BPE and self.chars.issuperset(word):
            return self._stable_path(word)
        n = len(word)
        score = [0.0] + [-np.inf] * n
        back: list[tuple[int, int]] = [(0, -1)] * (n + 1)  # where the last piece begins, and its id (-1: unknown)
        matches = self.automaton.iter(word)
        last, found = next(matches, (n, None))
        for to in range(1, n + 1):
            if word[to - 1] not in self.chars:
                back[to], score[to] = (to - 1, -1), score[to - 1] + self.unknown_score
            while last < to:
                i, size = found
                start = to - size
                if self.model == BPE:
                    if score[start] > -np.inf and self._stable(back[start][1] if start else -1, i):
                        back[to], score[to] = (start, i), 0.0
                else:
                    gain = score[start] + self.scores[i]
                    if gain > score[to] or (gain == score[to] and start < back[to][0]):
                        back[to], score[to] = (start, i), gain
                last, found = next(matches, (n, None))
        out, to = [], n
        while to:
            start, i = back[to]
            out.append([i] if i >= 0 else self._spelled(word[start]))
            to = start
        return self._joined(out[::-1])

    def _stable_path(self, word: str) -> list[int]:
        """The same pass where every character is known: each place has one admissible last piece."""
        ends = [-1] * (len(word) + 1)
        stable = self.stable
        for last, (i, size) in self.automaton.iter(word):
            to = last + 1
            if ends[to] < 0:
                start = to - size
                before = ends[start]
                if before >= 0 or not start:
                    known = stable[before].get(i)
                    if known or (known is None and self._stable(before, i)):
                        ends[to] = i
        out, to = [], len(word)
        while to:
            out.append(ends[to])
            to -= self.sizes[ends[to]]
        return out[::-1]

    def _joined(self, steps: list[list[int]]) -> list[int]:
        """Neighbouring unknown characters without a spelling are one unknown piece."""
        out: list[int] = []
        for step in steps:
            if step == [self.unknown] and out and out[-1] == self.unknown:
                continue
            out += step
        return out

    def _word(self, word: str) -> bytes:
        """Ids of a word with its blanks, cut where no piece can cross."""
        if self.cuts:
            inside = self.inside
            ends = [k for k in range(1, len(word)) if word[k - 1 : k + 1] not in inside]
            if ends:
                return b"".join([self._unit(word[a:b]) for a, b in zip([0, *ends], [*ends, len(word)])])
        return self._unit(word)

    def _unit(self, text: str) -> bytes:
        ids = self.units.get(text)
        if ids is None:
            ids = array("i", self._path(text)).tobytes()
            if len(text) <= LONGEST_CACHED:
                if len(self.units) >= CACHED_WORDS:
                    self.units.clear()
                self.units[text] = ids
        return ids

    @staticmethod
    def _plain(text: str) -> bool:
        """Whether every word has one blank before it."""
        return text[0] != " " and "  " not in text and BLANK not in text

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        plain = {i: t.split(" ") for i, t in enumerate(texts) if t and self.by_word and self._plain(t)}
        wanted = {w for w in set().union(*plain.values()) if w not in self.words}
        if len(self.words) + len(wanted) > CACHED_WORDS:
            self.old_words, self.words = self.words, {}
            wanted = set().union(*plain.values())
        for word in wanted:
            self.words[word] = self.old_words.get(word) or self._word(BLANK + word)
        known = self.words.__getitem__
        out = [b"".join(map(known, plain[i])) if i in plain else self._other(t) for i, t in enumerate(texts)]
        for word in wanted:
            if len(word) > LONGEST_CACHED:
                del self.words[word]
        return [np.frombuffer(x, np.int32) for x in out]

    def _other(self, text: str | None) -> bytes:
        """Ids of a text with blanks in a row or at its beginning, or of a model whose pieces cross words."""
        if not text:
            return b""
        line = (BLANK if self.prefix else "") + text.replace(" ", BLANK)
        return b"".join(map(self._word, _WORD.findall(line) if self.by_word else [line]))

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_batch([text])[0]

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


_WORD = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    """One for each file in each Python worker."""
    return Tokenizer(path)


def encoded(text: Column, path: str) -> Column:
    """Ids of a text column as ``array<int>``. The file must be at ``path`` on every machine."""

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = tokenizer(path)
        for batch in batches:
            yield _lists(own.encode_batch(batch.to_pylist()))

    return run(text)


def decoded(ids: Column, path: str) -> Column:
    """Text of a column of ids; null for null."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = tokenizer(path)
        for batch in batches:
            yield pa.array([None if x is None else own.decode(x) for x in batch.to_pylist()], pa.string())

    return run(ids)


def _lists(ids: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)]).astype(np.int32)
    values = np.concatenate(ids) if ids else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))


def round_trip(text: Column, path: str) -> Column:
    """Ids of a text column, and whether they decode to the text (null: to nothing), in one pass of one worker.

    Decoding where the ids are made needs no second worker with its own tables, and no text goes back.
    """

    @F.arrow_udf("struct<ids:array<int>,restored:boolean>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = tokenizer(path)
        for batch in batches:
            texts = batch.to_pylist()
            ids = own.encode_batch(texts)
            restored = [own.decode(x.tolist()) == (t or "") for x, t in zip(ids, texts)]
            yield pa.StructArray.from_arrays([_lists(ids), pa.array(restored, pa.bool_())], ["ids", "restored"])

    return run(text)


def with_round_trip(
    docs: DataFrame, path: str, text_col: str = "text", out: str = "encoded", at_once: int = 1_000
) -> DataFrame:
    """``docs`` and a struct of the ids of its texts and whether they decode to them; ``at_once``: texts a batch."""
    text_batches(docs.sparkSession, at_once)
    return docs.withColumn(fresh(docs, out), round_trip(docs[text_col], path))


def with_ids(docs: DataFrame, path: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` and the ids of its texts."""
    text_batches(docs.sparkSession)
    return docs.withColumn(fresh(docs, out), encoded(docs[text_col], path))


def with_text(docs: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` and the texts of its ids."""
    text_batches(docs.sparkSession)
    return docs.withColumn(fresh(docs, out), decoded(docs[ids_col], path))
