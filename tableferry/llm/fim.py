"""Fill-in-the-middle transformation by displacement scatter.

A text is cut into units (white space with the word after it; white space at the end is a unit), a
keyed hash of the document's id draws two cuts and a form, and the three pieces are written in the
form's order behind sentinels. All texts of a batch are handled as one run of bytes: cuts come from a
scan of the bytes, a difference array holds at each piece's first byte by how much its shift differs
from the one before, its cumulative sum is every byte's shift, and one scatter builds the outputs.
Restoring reads the sentinels of an output, derives the shifts from them and gathers the bytes
back. The scatter and the gather work through windows of bytes, so a very long text needs no more than
itself and its output.

White space is the six ASCII characters, and the sentinels are ASCII, so bytes may be scanned in place
of characters: no byte of a longer UTF-8 sequence is equal to one of theirs.

Defined results: a null or empty text is ``plain`` with the output ""; a text that holds a sentinel is
``plain`` and comes out as it is; a document without an id is drawn by the text ``42:`` alone; equal
rows have equal results; an empty table gives an empty one. Other columns are kept, and a new
column gets a trailing underscore where its name is taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import text_batches
from .text import fresh

SENTINELS = ("<P>", "<S>", "<M>")  # fixed values: prefix, suffix, middle
PLAIN, PSM, SPM = "plain", "psm", "spm"
# Order of the pieces (0 prefix, 1 suffix, 2 middle), each behind its sentinel.
ORDER = {PSM: (0, 1, 2), SPM: (1, 0, 2)}
SEED = 42
FIM_PERCENT = 50  # of the documents are rearranged ...
SPM_PERCENT = 80  # ... and of those so many with the suffix first
WINDOW = 1 << 22  # bytes that are moved at once
RESULT = "struct<n:long,form:string,prefix_chars:long,middle_chars:long,output:string>"


def _is_space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def unit_ends(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where units end, in ascending order, and the number of units of each text.

    ``starts`` has one more entry than there are texts. A unit ends behind a character that is no white
    space if white space or the text's end follows, and at the text's end.
    """
    n = len(starts) - 1
    space = _is_space(data)
    last = np.zeros(len(data), bool)
    last[starts[1:][starts[1:] > starts[:-1]] - 1] = True
    ends = ~space
    ends[:-1] &= space[1:] | last[:-1]
    ends |= last
    at = np.flatnonzero(ends) + 1
    counts = np.searchsorted(at, starts[1:], "right") - np.searchsorted(at, starts[:-1], "right")
    return at, counts.astype(np.int64).reshape(n)


def _found(data: np.ndarray, word: str) -> np.ndarray:
    """Places where the bytes of ``word`` begin."""
    own = word.encode()
    if len(data) < len(own):
        return np.empty(0, np.int64)
    hit = data[: len(data) - len(own) + 1] == own[0]
    for k, byte in enumerate(own[1:], 1):
        hit &= data[k : len(data) - len(own) + 1 + k] == byte
    return np.flatnonzero(hit)


def _shifts(first: np.ndarray, shift: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """Every byte's target, window by window; ``first`` (ascending) begins a run that moves by ``shift``.

    The difference array of a window holds the change of shift at each run's first byte.
    """
    change = np.diff(shift, prepend=0)
    carry = 0
    for at in range(0, size, WINDOW):
        end = min(at + WINDOW, size)
        difference = np.zeros(end - at, np.int64)
        own = slice(np.searchsorted(first, at), np.searchsorted(first, end))
        np.add.at(difference, first[own] - at, change[own])
        difference[0] += carry
        moved = np.cumsum(difference)
        carry = int(moved[-1])
        moved += np.arange(at, end)
        yield at, moved


def _spread(pieces: np.ndarray, orders: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first bytes, shifts, output starts) of rearranged texts.

    ``pieces[i]`` are the sizes of text i's prefix, middle and suffix; ``orders[i]`` is 1 for the suffix
    first and 0 for the prefix first; ``starts`` are the texts' first bytes and the end of the last.
    """
    prefix, middle, suffix = pieces.T
    mark = len(SENTINELS[0])
    sizes = pieces.sum(axis=1) + 3 * mark
    out = np.concatenate([[0], np.cumsum(sizes)])
    base = out[:-1]
    to_prefix = base + np.where(orders == 1, 2 * mark + suffix, mark)
    to_suffix = base + np.where(orders == 1, mark, 2 * mark + prefix)
    to_middle = base + 3 * mark + prefix + suffix
    first = np.stack([starts[:-1], starts[:-1] + prefix, starts[:-1] + prefix + middle], axis=1)
    target = np.stack([to_prefix, to_middle, to_suffix], axis=1)
    return first, target - first, out


def rearranged(data: np.ndarray, starts: np.ndarray, cuts: np.ndarray, orders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Output bytes and their starts for texts cut at ``cuts`` (two places in each text's bytes)."""
    sizes = np.stack([cuts[:, 0], cuts[:, 1] - cuts[:, 0], np.diff(starts) - cuts[:, 1]], axis=1)
    first, shift, out_starts = _spread(sizes, orders, starts)
    # An empty piece begins where the next one does; the later change at one place then counts as well.
    out = np.empty(out_starts[-1], np.uint8)
    for at, target in _shifts(first.ravel(), shift.ravel(), len(data)):
        out[target] = data[at : at + len(target)]
    places = (first + shift) - len(SENTINELS[0])  # each piece stands right behind its sentinel
    for k, sentinel in enumerate((SENTINELS[0], SENTINELS[2], SENTINELS[1])):
        for j, byte in enumerate(sentinel.encode()):
            out[places[:, k] + j] = byte
    return out, out_starts


def gathered(out: np.ndarray, out_starts: np.ndarray, orders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text bytes and their starts, from outputs and their orders alone: the inverse of ``rearranged``."""
    n, mark = len(orders), len(SENTINELS[0])
    spots = {}
    for sentinel in SENTINELS:
        at = _found(out, sentinel)
        spots[sentinel] = at[np.searchsorted(at, out_starts[:-1])] if n else at
    p, s, m = (spots[x] for x in SENTINELS)
    ends = out_starts[1:]
    prefix = np.where(orders == 1, m, s) - p - mark
    suffix = np.where(orders == 1, p, m) - s - mark
    middle = ends - m - mark
    sizes = np.stack([prefix, middle, suffix], axis=1)
    starts = np.concatenate([[0], np.cumsum(sizes.sum(axis=1))])
    first = np.stack([starts[:-1], starts[:-1] + prefix, starts[:-1] + prefix + middle], axis=1)
    source = np.stack([p, m, s], axis=1) + mark
    data = np.empty(starts[-1], np.uint8)
    for at, origin in _shifts(first.ravel(), (source - first).ravel(), len(data)):
        data[at : at + len(origin)] = out[origin]
    return data, starts


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array and the texts' starts; null counts as empty."""
    texts = texts.fill_null("").cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    starts = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if offsets else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    return raw[starts[0] : starts[-1]], starts - starts[0]


def _strings(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    buffers = [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(data)]
    return pa.Array.from_buffers(pa.large_string(), len(starts) - 1, buffers)


def _runs(starts: np.ndarray, chosen: np.ndarray) -> list[tuple[int, int]]:
    """Rows in runs of about a window of bytes, so that whole batches are never held several times over."""
    out, at = [], 0
    while at < len(chosen):
        end = max(at + 1, int(np.searchsorted(starts, starts[at] + WINDOW, "right")) - 1)
        out.append((at, min(end, len(chosen))))
        at = out[-1][1]
    return out


def _characters(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def _some(texts: pa.Array, draws: np.ndarray, fim_percent: int, spm_percent: int) -> list[pa.Array]:
    data, starts = _bytes(texts)
    ends, counts = unit_ends(data, starts)
    n = len(counts)
    cut = np.sort(draws[:, :2] % (counts[:, None] + 1), axis=1)
    before = np.searchsorted(ends, starts[:-1], "right")  # units of earlier texts
    at_start = np.concatenate([ends, [0]])
    places = np.where(cut > 0, at_start[np.maximum(before[:, None] + cut - 1, 0)], starts[:-1, None])
    plain = (counts == 0) | (draws[:, 2] % 100 >= fim_percent)
    for sentinel in SENTINELS:
        at = _found(data, sentinel)
        row = np.searchsorted(starts, at, "right") - 1
        whole = at + len(sentinel) <= starts[row + 1]  # not across two texts
        plain[row[whole]] = True
    orders = (draws[:, 3] % 100 < spm_percent).astype(np.int64)
    forms = np.where(plain, PLAIN, np.where(orders == 1, SPM, PSM))
    own = np.flatnonzero(~plain)
    outputs = texts.fill_null("").cast(pa.large_string())
    sizes = np.zeros((n, 2), np.int64)
    if len(own):
        taken = outputs.take(pa.array(own))
        bytes_, own_starts = _bytes(taken)
        cuts = places[own] - starts[own][:, None]
        moved, moved_starts = rearranged(bytes_, own_starts, cuts, orders[own])
        for row, at, (a, b) in zip(own.tolist(), own_starts.tolist(), cuts.tolist()):
            sizes[row] = _characters(bytes_[at : at + a]), _characters(bytes_[at + a : at + b])
        outputs = pa.concat_arrays([outputs, _strings(moved, moved_starts)])
        pick = np.arange(n)
        pick[own] = n + np.arange(len(own))
        outputs = outputs.take(pa.array(pick))
    mask = plain
    return [
        pa.array(counts), pa.array(forms.tolist(), pa.string()), pa.array(sizes[:, 0], mask=mask), pa.array(sizes[:, 1], mask=mask),
        outputs,
    ]


def drawn(doc: Column, seed: int = SEED) -> Column:
    """The first four groups of eight hex digits of the hash of ``seed:id``, as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)])


def transformed_column(text: Column, draws: Column, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> Column:
    names = ("n", "form", "prefix_chars", "middle_chars", "output")

    @F.arrow_udf(RESULT)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, drawn_ in batches:
            numbers = np.asarray(drawn_.flatten(), np.int64).reshape(len(texts), 4)
            _, starts = _bytes(texts)
            parts = [
                _some(texts.slice(a, b - a), numbers[a:b], fim_percent, spm_percent) for a, b in _runs(starts, numbers)
            ]
            if not parts:
                yield pa.array([], pa.struct([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
                                              ("middle_chars", pa.int64()), ("output", pa.string())]))
                continue
            columns = [pa.concat_arrays(c) for c in zip(*parts)]
            columns[4] = columns[4].cast(pa.string())
            yield pa.StructArray.from_arrays(columns, list(names))

    return run(text, draws)


def restored_column(output: Column, form: Column) -> Column:
    """The text of an output and its form; null for null."""

    @F.arrow_udf("string")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for outputs, forms in batches:
            parts = []
            _, starts = _bytes(outputs)
            for a, b in _runs(starts, np.arange(len(outputs))):
                some = outputs.slice(a, b - a).cast(pa.large_string())
                own_forms = np.array(forms.slice(a, b - a).to_pylist(), object)
                own = np.flatnonzero((own_forms == PSM) | (own_forms == SPM))
                if len(own):
                    data, at = gathered(*_bytes(some.take(pa.array(own))), (own_forms[own] == SPM).astype(np.int64))
                    pick = np.arange(len(some))
                    pick[own] = len(some) + np.arange(len(own))
                    some = pa.concat_arrays([some, _strings(data, at)]).take(pa.array(pick))
                parts.append(some.cast(pa.string()))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return run(output, form)


def transformed(
    docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", out: str = "fim", seed: int = SEED,
    fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT,
) -> DataFrame:
    """``docs`` and a struct of ``n`` units, ``form``, sizes of prefix and middle, and ``output``."""
    text_batches(docs.sparkSession)
    found = transformed_column(docs[text_col], drawn(docs[doc_col], seed), fim_percent, spm_percent)
    return docs.withColumn(fresh(docs, out), found)


def restored(docs: DataFrame, output: Column, form: Column, out: str = "restored") -> DataFrame:
    """``docs`` and the text that each output and form came from."""
    text_batches(docs.sparkSession)
    return docs.withColumn(fresh(docs, out), restored_column(output, form))
