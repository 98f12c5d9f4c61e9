"""BPE ids and texts through a table of distinct words.

Texts are split into words in the JVM, at white space and between a Latin letter and a following ASCII
mark or digit. A vocabulary of this kind drops white space and never merges across those places, so
a word's ids do not depend on its neighbours, and each distinct word of the whole corpus is encoded
once. Words are then exchanged for their ids by position:

1. A task turns its documents into blocks of bounded size: the block's distinct words, and each document
   as the numbers of its words. The numbers stay in a file of the shared folder; the words are a
   written table with one row a block.
2. The blocks' words meet by word. Each distinct word is encoded once, and its ids go back to the (block,
   number) pairs it came from.
3. A block's ids are put in the places that its file names.

So what is shuffled is one row for each distinct word of a block, not one for each word, a word that is
in every block has one row a block, and a block is all that one task holds. A written table says which
files count: those of lost or repeated tasks are in no row of it.

Defined results: a null or empty text has no ids and the text ""; names of added tokens in a text are
those tokens, as in the library; equal rows stay apart; an empty table gives an empty one; a very long
text is a block of its own; other columns are kept, whatever their names. Decoding gives pieces with a
blank between them, as the library does for files without a decoder; ids outside the vocabulary are
left out. Files that cut texts in another way are refused.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableferry.session import work_dir

from .arrow import text_batches
from .stored import written
from .text import BLANK, fresh

BLOCK_BYTES = 64 << 20  # of words, before a block ends
ROWS_AT_ONCE = 1_000  # documents whose ids are put together at once
NORMALIZERS = ("NFC", "Replace", "Lowercase")  # fixed values: kinds that never look across white space
LATIN = "A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u024F"  # letters that stay letters in lower case (U+0130 does not)
_ASCII_MARKS = [chr(c) for c in range(33, 127) if not chr(c).isalpha()]


class Vocabulary:
    """One tokenizer file, checked to be of the kind whose words can be encoded alone."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        how = json.loads(self.library.to_str())
        steps = (how.get("normalizer") or {}).get("normalizers", [])
        cuts = (how.get("pre_tokenizer") or {}).get("pretokenizers", [])
        split = cuts[0] if cuts else {}
        drops_space = split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert") \
            and split["pattern"].get("Regex", "").endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        plain_bytes = [c.get("type") for c in cuts[1:]] == ["ByteLevel"] and not cuts[1].get("add_prefix_space") \
            and not cuts[1].get("use_regex")
        if not (drops_space and plain_bytes and tuple(s["type"] for s in steps) == NORMALIZERS
                and not how.get("post_processor") and not how.get("decoder")):
            raise ValueError(f"words of {path} cannot be encoded alone")
        self.added = [t["content"] for t in how["added_tokens"]]
        by_id = {i: piece for piece, i in self.library.get_vocab(with_added_tokens=True).items()}
        self.pieces = pa.array([by_id.get(i) for i in range(max(by_id) + 1)], pa.string())
        self.kind = "<u2" if len(self.pieces) <= 65_536 else "<u4"


    def splitter(self) -> str:
        """Where words end. Marks that occur in added tokens end none, so that no token's name is cut."""
        named = set("".join(self.added))
        marks = "".join(f"\\x{ord(c):02X}" for c in _ASCII_MARKS if c not in named)
        return f"{BLANK}|(?<=[{LATIN}])(?=[{marks}])"

    def ids(self, words: list[str]) -> list[list[int]]:
        return [x.ids for x in self.library.encode_batch_fast(words, add_special_tokens=False)]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One for each file in each Python worker."""
    return Vocabulary(path)


def _open(location: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(location) if "://" in location else (fs.LocalFileSystem(), location)


def packed(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers as bytes, seven bits in each and the low ones first, and where each number ends."""
    sizes = 1 + sum((numbers >= 1 << 7 * k).astype(np.int64) for k in range(1, 5))
    ends = np.cumsum(sizes)
    out = np.zeros(ends[-1] if len(ends) else 0, np.uint8)
    for k in range(5):
        own = sizes > k
        more = np.where(sizes[own] > k + 1, 128, 0)
        out[ends[own] - sizes[own] + k] = numbers[own] >> 7 * k & 127 | more
    return out, ends


def unpacked(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of ``packed`` bytes, and where each ends."""
    ends = np.flatnonzero(data < 128) + 1
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    out = np.zeros(len(ends), np.int64)
    for k in range(5):
        own = starts + k < ends
        out[own] |= (data[starts[own] + k].astype(np.int64) & 127) << 7 * k
    return out, ends


class _Block:
    """Documents on their way into a block: the numbers of their words, and the distinct words so far."""

    def __init__(self, added: list[str]) -> None:
        self.added = [name.lower() for name in added]
        self.known: dict[str, int] = {}
        self.parts: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        self.size = 0

    def _numbers(self, words: pa.Array) -> np.ndarray:
        """Words of ASCII alone count in lower case, unless that would make an added token's name of them."""
        lower, fits = pc.ascii_lower(words), pc.string_is_ascii(words)
        for name in self.added:
            fits = pc.and_not(fits, pc.match_substring(lower, name))
        known = self.known
        return np.array([known.setdefault(w, len(known)) for w in pc.if_else(fits, lower, words).to_pylist()], np.int32)

    def add(self, batch: pa.RecordBatch) -> None:
        words = batch.column("words")
        flat, offsets = words.flatten(), np.asarray(words.offsets)
        some = pc.not_equal(flat, "")
        ends = np.concatenate([[0], np.cumsum(np.asarray(some))])[offsets - offsets[0]].astype(np.int32)
        coded = flat.filter(some).dictionary_encode()
        numbers = self._numbers(coded.dictionary)
        self.parts.append((batch.column("row"), ends, numbers[np.asarray(coded.indices)]))
        self.size += flat.nbytes

    def write(self, out) -> list[str]:
        """Writes the documents; the words in the order of the numbers they have there, most frequent first."""
        counts = np.zeros(len(self.known), np.int64)
        for _, _, numbers in self.parts:
            counts += np.bincount(numbers, minlength=len(counts))
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        schema = pa.schema([pa.field("row", self.parts[0][0].type), pa.field("words", pa.binary())])
        with pq.ParquetWriter(out, schema, compression="zstd", use_dictionary=["row"]) as sink:
            for row, ends, numbers in self.parts:
                data, until = packed(rank[numbers].astype(np.int64))
                bounds = np.concatenate([[0], until])[ends].astype(np.int32)
                coded = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
                sink.write_table(pa.Table.from_arrays([row, coded], schema=schema))
        words = list(self.known)
        return [words[i] for i in order.tolist()]


def _to_blocks(location: str, added: list[str]):
    def written_out(number: int, block: _Block) -> pa.RecordBatch:
        store, root = _open(location)
        with store.open_output_stream(f"{root}/{number:x}") as out:
            words = block.write(out)
        known = [words or [""]]  # so that a block without words has a row as well
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array(known, pa.list_(pa.string()))], ["block", "words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = TaskContext.get().taskAttemptId() << 20, 0  # an attempt's number is given once
        block = _Block(added)
        for batch in batches:
            if batch.num_rows:
                block.add(batch)
            if block.size >= BLOCK_BYTES:
                yield written_out(first + made, block)
                block, made = _Block(added), made + 1
        if block.parts:
            yield written_out(first + made, block)

    return run


def _encoded(word: Column, path: str) -> Column:
    """Ids of words as little-endian bytes, two or four for each id."""

    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = vocabulary(path)
        for batch in batches:
            yield pa.array([np.array(x, own.kind).tobytes() for x in own.ids(batch.to_pylist())], pa.binary())

    return run.asNondeterministic()(word)  # else the planner may run it once more, before the words are distinct


def _placed(location: str, kind: str):
    def rows(block: int, known: pa.ChunkedArray) -> Iterator[pa.RecordBatch]:
        """The block's documents with their ids; ``known`` holds its words' ids in the order of their numbers."""
        ids = known.combine_chunks()
        _, offsets, data = ids.buffers()
        ends = np.frombuffer(offsets, np.int32)[ids.offset : ids.offset + len(ids) + 1] // np.dtype(kind).itemsize
        flat, starts, sizes = np.frombuffer(data or b"", kind), ends[:-1], np.diff(ends)
        store, root = _open(location)
        with store.open_input_file(f"{root}/{block:x}") as source:
            table = pq.read_table(source).combine_chunks()
        for at in range(0, table.num_rows, ROWS_AT_ONCE):
            some = table.slice(at, ROWS_AT_ONCE)
            coded = some.column("words").combine_chunks()
            bounds = np.frombuffer(coded.buffers()[1], np.int32)[coded.offset : coded.offset + len(coded) + 1]
            data = np.frombuffer(coded.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
            numbers, ends = unpacked(data)
            bounds = np.searchsorted(ends, bounds - bounds[0], "right")  # of each document's words
            own = sizes[numbers]
            until = np.concatenate([[0], np.cumsum(own, dtype=np.int64)])
            # where each id lies: the word's first, and how far the id is behind it
            spots = np.repeat(starts[numbers] - until[:-1], own) + np.arange(until[-1])
            values = pa.array(flat[spots].astype(np.int32))
            lists = pa.ListArray.from_arrays(pa.array(until[bounds].astype(np.int32)), values)
            yield pa.RecordBatch.from_arrays([some.column("row").combine_chunks(), lists], ["row", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []
        for batch in batches:
            at, blocks = 0, np.asarray(batch.column("block"))
            for end in [*(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]:
                if at < end:
                    if block is not None and blocks[at] != block:
                        yield from rows(block, pa.chunked_array(held))
                        held = []
                    block = int(blocks[at])
                    held.append(batch.column("ids").slice(at, end - at))
                at = end
        if held:
            yield from rows(block, pa.chunked_array(held))

    return run


def encoded(docs: DataFrame, path: str, text_col: str = "text", keep: list[str] | None = None, out: str = "ids") -> DataFrame:
    """The kept columns (all, if none are named) and the ``ids`` of each text, as the library gives them."""
    spark = docs.sparkSession
    text_batches(spark)
    own = vocabulary(path)
    location = work_dir(spark, "bpe-blocks")
    store, root = _open(location)
    store.create_dir(root, recursive=True)
    keep = docs.columns if keep is None else keep
    words = F.split(F.coalesce(docs[text_col], F.lit("")), own.splitter())
    rows = docs.select(F.struct(*[docs[c] for c in keep]).alias("row"), words.alias("words"))
    blocks = written(rows.mapInArrow(_to_blocks(location, own.added), "block long, words array<string>"), "bpe-words", "zstd")
    # One exchange of the blocks' words serves the distinct words and the way back: both ask for all its columns.
    places = blocks.select("block", F.posexplode("words").alias("number", "word"))
    places = places.filter("word is not null").repartition("word")
    distinct = places.groupBy("word").agg(F.min(F.struct("block", "number")).alias("first")).filter("first is not null")
    table = distinct.select("word", _encoded(F.col("word"), path).alias("ids"))
    found = places.hint("merge").join(table, "word").select("block", "number", "ids")
    kind = T.StructType().add("row", rows.schema["row"].dataType).add("ids", T.ArrayType(T.IntegerType()))
    placed = found.repartition("block").sortWithinPartitions("block", "number").mapInArrow(_placed(location, own.kind), kind)
    return placed.select(*[F.col(f"row.`{c}`").alias(c) for c in keep], F.col("ids").alias(fresh(keep, out)))


def decoded(docs: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` and the texts of a column of ids; null for null."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = vocabulary(path).pieces
        for ids in batches:
            flat = ids.flatten()
            known = pc.fill_null(pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(pieces))), False)
            spelled = pieces.take(pc.if_else(known, flat, None))
            known = np.asarray(pc.is_valid(spelled))
            bounds = np.asarray(pc.fill_null(pc.list_value_length(ids), 0)).astype(np.int64)
            kept = np.concatenate([[0], np.cumsum(known)])[np.concatenate([[0], np.cumsum(bounds)])]
            lists = pa.ListArray.from_arrays(pa.array(kept.astype(np.int32)), spelled.drop_null())
            yield pc.if_else(ids.is_valid(), pc.binary_join(lists, " "), None)

    text_batches(docs.sparkSession)
    return docs.withColumn(fresh(docs, out), run(docs[ids_col].cast("array<int>")))
