"""Token ids as length-delimited binary records, with a separate offset index for shuffled reads.

Format of a data file: for each record the length of its payload (u64), the masked checksum of these
eight bytes (u32), the payload, and the payload's masked checksum (u32), all little-endian. The
checksum is CRC-32C, masked by a rotation of 15 bits and an addition. The payload is one byte of
flags (1: has an id, 2: wide ids), the document's id (i64) and the token ids (u16, or u32 for
vocabularies beyond 65,536). The index file beside it holds each record's offset (u64).

Writing: documents are range-partitioned by id, so the files in order of (partition, number) hold
ascending ids. A task writes files of bounded size under names of its own and returns one manifest
row for each. The manifest is a written table: files of lost or repeated tasks are in no manifest and
so do not count. Where a document's ids begin among all ids is a running sum over the manifest,
one row a file, added while reading. Nothing of the data passes the driver.

Defined results: a null text counts as empty; an empty text is the end id alone; documents without
an id come first and get null back; equal ids are ordered by text; an empty table gives an empty
manifest; other columns are not written.
"""

from __future__ import annotations

import json
import posixpath
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tableferry.session import work_dir

from .arrow import text_batches
from .stored import written

FILE_BYTES = 32 << 20
HAS_ID, WIDE = 1, 2
POLYNOMIAL = 0x82F63B78  # fixed value: CRC-32C, reflected
MASK = 0xA282EAD8  # fixed value: added to the rotated checksum
CACHED = 400_000  # stretches in each generation
CHUNK = 512  # bytes that are summed in parallel
MOST_TASKS = 50_000  # that read files back; beyond that a task reads several
MANIFEST = "part int, number int, file string, records long, ids long"


@lru_cache(maxsize=1)
def _tables() -> np.ndarray:
    """``[k, b]``: what byte b adds to the sum when k more bytes follow it in a group of eight."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1).astype(np.uint32)
    out = [table]
    for _ in range(7):
        out.append((out[-1] >> np.uint32(8)) ^ table[out[-1] & 255])
    return np.array(out)


@lru_cache(maxsize=1)
def _pair_tables() -> np.ndarray:
    """The same for two bytes at once: ``[k, v]`` for the k-th pair of a group of eight."""
    t, v = _tables(), np.arange(65_536)
    return np.array([t[7 - 2 * k][v & 255] ^ t[6 - 2 * k][v >> 8] for k in range(4)])


def _raw_sums(rows: np.ndarray) -> np.ndarray:
    """Sums, started at zero, of the rows of a byte matrix whose width is a multiple of eight."""
    t, state = _pair_tables(), np.zeros(len(rows), np.uint64)
    for group in np.ascontiguousarray(rows.view("<u8").T):
        pairs = (group ^ state).view("<u2").reshape(-1, 4)
        state = (t[0][pairs[:, 0]] ^ t[1][pairs[:, 1]] ^ t[2][pairs[:, 2]] ^ t[3][pairs[:, 3]]).astype(np.uint64)
    return state.astype(np.uint32)


@lru_cache(maxsize=1)
def _past_chunk() -> np.ndarray:
    """``[k, b]``: what byte k of a sum becomes when a chunk of zeros follows."""
    state = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).ravel()
    table = _tables()[0]
    for _ in range(CHUNK):
        state = (state >> np.uint32(8)) ^ table[state & 255]
    return state.reshape(4, 256)


def checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Masked CRC-32C of the byte ranges (each of four bytes at least) of a buffer.

    Leading zeros do not change a sum that starts at zero, so every range is padded in front to whole
    chunks; the usual start value is the same as flipping the first four bytes.
    """
    n = len(starts)
    if not n:
        return np.empty(0, np.uint32)
    sizes = ends - starts
    chunks = -(-sizes // CHUNK)
    first = np.concatenate([[0], np.cumsum(chunks)])
    padded = np.zeros(int(first[-1]) * CHUNK, np.uint8)
    targets = first[1:] * CHUNK - sizes
    for start, end, target in zip(starts.tolist(), ends.tolist(), targets.tolist()):
        padded[target : target + end - start] = data[start:end]
    for k in range(4):
        padded[targets + k] ^= 255
    sums = _raw_sums(padded.reshape(-1, CHUNK))
    past, state = _past_chunk(), np.zeros(n, np.uint32)
    order = np.argsort(-chunks, kind="stable")
    for k in range(int(chunks.max())):
        own = order[: np.searchsorted(-chunks[order], -k)]  # ranges with more than k chunks
        s = state[own]
        moved = past[0][s & 255] ^ past[1][(s >> 8) & 255] ^ past[2][(s >> 16) & 255] ^ past[3][s >> 24]
        state[own] = moved ^ sums[first[own] + k]
    crc = state ^ np.uint32(0xFFFFFFFF)
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK)


def framed(payloads: list[bytes]) -> tuple[bytes, np.ndarray]:
    """The records of the payloads, one after the other, and their offsets."""
    lengths = np.array([len(p) for p in payloads], np.uint64)
    at = np.arange(len(payloads) + 1, dtype=np.int64) * 8
    head_sums = checksums(lengths.view(np.uint8), at[:-1], at[1:])
    ends = np.cumsum(lengths.astype(np.int64))
    body_sums = checksums(np.frombuffer(b"".join(payloads), np.uint8), ends - lengths.astype(np.int64), ends)
    parts = []
    for length, head, payload, body in zip(lengths, head_sums, payloads, body_sums):
        parts += [length.tobytes(), head.tobytes(), payload, body.tobytes()]
    return b"".join(parts), np.concatenate([[0], np.cumsum(lengths.astype(np.int64) + 16)[:-1]]).astype(np.int64)


def unframed(data: bytes, offsets: np.ndarray) -> list[bytes]:
    """Payloads of the records at the offsets; raises if a checksum is wrong."""
    raw = np.frombuffer(data, np.uint8)
    at = offsets.astype(np.int64)
    fields = raw[at[:, None] + np.arange(12)]
    lengths = fields[:, :8].copy().view(np.uint64)[:, 0].astype(np.int64)
    if (checksums(raw, at, at + 8) != fields[:, 8:].copy().view(np.uint32)[:, 0]).any():
        raise ValueError("a record's length does not match its checksum")
    ends = at + 12 + lengths
    if (checksums(raw, at + 12, ends) != raw[ends[:, None] + np.arange(4)].copy().view(np.uint32)[:, 0]).any():
        raise ValueError("a record does not match its checksum")
    return [data[s:e] for s, e in zip((at + 12).tolist(), ends.tolist())]


def payload(doc: int | None, ids: bytes, wide: bool) -> bytes:
    flags = (HAS_ID if doc is not None else 0) | (WIDE if wide else 0)
    return bytes([flags]) + int(doc or 0).to_bytes(8, "little", signed=True) + ids


def parsed(record: bytes) -> tuple[int | None, np.ndarray]:
    doc = int.from_bytes(record[1:9], "little", signed=True) if record[0] & HAS_ID else None
    return doc, np.frombuffer(record, "<u4" if record[0] & WIDE else "<u2", offset=9)


class Encoder:
    """The library's ids of whole texts, as little-endian bytes.

    Byte-level vocabularies of this kind cut a text before every single blank between two characters that
    are no white space, so the stretches between such blanks can be encoded alone. Most recur, and their
    ids are kept in two bounded generations of a cache. A run of white space is one piece to the library,
    whose tokens may cross the blanks in it (no-break spaces do), so texts with a blank beside other
    white space, that is, with a stretch that is empty or begins or ends with white space, go to it as they are.
    So do texts that name an added token, which the library finds in the text as it stands, and every text if the file
    says it cuts texts in another way.
    """

    def __init__(self, path: str, end_id: int = 0) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.wide = max(self.library.get_vocab_size(), end_id + 1) > 65_536
        self.kind = "<u4" if self.wide else "<u2"
        self.end = np.array([end_id], self.kind).tobytes()
        cut = json.loads(self.library.to_str())
        how = cut.get("pre_tokenizer") or {}
        self.by_stretch = how.get("type") == "ByteLevel" and how.get("use_regex") and not how.get("add_prefix_space") \
            and not cut.get("normalizer")
        self.added = [t["content"] for t in cut.get("added_tokens", [])]
        # a byte-level token is written with one character for each of its bytes
        size = self.library.get_vocab_size()
        self.token_bytes = np.array([len(self.library.id_to_token(i) or "") for i in range(size)], np.int64)
        self.new: dict[str, bytes | None] = {}  # None: a text with this stretch goes to the library whole
        self.old: dict[str, bytes | None] = {}

    def _direct(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, self.kind).tobytes() for x in found]

    def _stretches(self, words: list[str]) -> list[bytes]:
        """Ids of " word" for each word: one call for all of them, cut again by the tokens' lengths in bytes."""
        ids = np.array(self.library.encode_batch_fast([" " + " ".join(words)], add_special_tokens=False)[0].ids, np.int64)
        ends = np.cumsum([len(w.encode()) + 1 for w in words])
        cuts = np.searchsorted(np.cumsum(self.token_bytes[ids]), ends) + 1
        raw, width = ids.astype(self.kind).tobytes(), 4 if self.wide else 2
        bounds = [0, *(cuts * width).tolist()]
        return [raw[a:b] for a, b in zip(bounds, bounds[1:])]

    def _learned(self, words: list[str]) -> list[bytes | None]:
        """Ids of distinct stretches behind a blank; new ones go into the cache."""
        wanted = [w for w in words if w not in self.new]
        if len(self.new) + len(wanted) > CACHED:
            self.old, self.new = self.new, {}
            wanted = words
        again = {w: self.old[w] for w in wanted if w in self.old}
        self.new.update(again)
        missing = [w for w in wanted if w not in again] if again else wanted
        plain = [w for w in missing if w and w == w.strip()]
        if len(plain) < len(missing):
            self.new.update(dict.fromkeys(set(missing).difference(plain)))
            missing = plain
        for at in range(0, len(missing), 2_000):
            own = missing[at : at + 2_000]
            self.new.update(zip(own, self._stretches(own)))
        return list(map(self.new.__getitem__, words))

    def _by_stretch(self, texts: list[str]) -> list[bytes | None]:
        """Without the end id; none for texts that go to the library whole."""
        parts = pc.split_pattern(pa.array(texts, pa.string()), " ")
        offsets, words = parts.offsets.to_numpy(), parts.values
        behind = np.ones(len(words), bool)
        behind[offsets[:-1]] = False
        # every distinct stretch is looked up once; the others are its number, and their ids are copied as arrays
        coded = words.filter(pa.array(behind)).dictionary_encode()
        known = self._learned(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        number = coded.indices.to_numpy()
        firsts = words.take(pa.array(offsets[:-1])).to_pylist()
        bounds = offsets - offsets[0] - np.arange(len(offsets))
        odd = np.concatenate([[0], np.cumsum(np.array([ids is None for ids in known], bool)[number])])[bounds]
        blank = np.array([f[-1:].isspace() for f in firsts]) & (np.diff(bounds) > 0)
        whole = (np.diff(odd) > 0) | blank
        raw = np.frombuffer(b"".join([ids or b"" for ids in known]), self.kind)
        sizes = np.array([len(ids or b"") for ids in known], np.int64) // raw.itemsize
        starts, own = (np.cumsum(sizes) - sizes)[number], sizes[number]
        ends = np.concatenate([[0], np.cumsum(own)])
        ids = raw[np.arange(ends[-1]) + np.repeat(starts - ends[:-1], own)]
        cuts = ends[bounds].tolist()
        heads = self._direct(firsts)
        return [None if w else h + ids[a:b].tobytes() for w, h, a, b in zip(whole, heads, cuts, cuts[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        """With the end id."""
        cut = [i for i, t in enumerate(texts) if self.by_stretch and not any(name in t for name in self.added)]
        done = dict(zip(cut, self._by_stretch([texts[i] for i in cut]))) if cut else {}
        whole = [i for i in range(len(texts)) if done.get(i) is None]
        done.update(zip(whole, self._direct([texts[i] for i in whole])))
        return [done[i] + self.end for i in range(len(texts))]


@lru_cache(maxsize=2)
def _encoder(path: str, end_id: int) -> Encoder:
    """One for each file in each Python worker."""
    return Encoder(path, end_id)


def _open(location: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(location) if "://" in location else (fs.LocalFileSystem(), location)


class _Files:
    """Data and index files of one task, each of bounded size."""

    def __init__(self, location: str) -> None:
        self.store, self.root = _open(location)
        self.part, self.number, self.own = TaskContext.get().partitionId(), 0, uuid.uuid4().hex[:12]
        self.data = None
        self.rows: list[tuple] = []

    def add(self, payloads: list[bytes], ids: int) -> None:
        if self.data is None:
            self.name = f"part-{self.part:06d}-{self.number:04d}-{self.own}"
            self.data = self.store.open_output_stream(f"{self.root}/{self.name}.rec")
            self.offsets, self.size, self.ids = [], 0, 0
        data, offsets = framed(payloads)
        self.data.write(data)
        self.offsets.append(offsets + self.size)
        self.size += len(data)
        self.ids += ids
        if self.size >= FILE_BYTES:
            self.close()

    def close(self) -> None:
        if self.data is None:
            return
        self.data.close()
        offsets = np.concatenate(self.offsets)
        with self.store.open_output_stream(f"{self.root}/{self.name}.idx") as out:
            out.write(offsets.astype("<u8").tobytes())
        self.rows.append((self.part, self.number, self.name, len(offsets), self.ids))
        self.number += 1
        self.data = None


def _write(location: str, tokenizer_path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, files = _encoder(tokenizer_path, end_id), _Files(location)
        for batch in batches:
            docs, texts = batch.column("doc").to_pylist(), batch.column("text").to_pylist()
            ids = own.encode([t or "" for t in texts])
            for at in range(0, len(docs), 256):
                part = ids[at : at + 256]
                files.add(
                    [payload(d, i, own.wide) for d, i in zip(docs[at : at + 256], part)],
                    sum(map(len, part)) // (4 if own.wide else 2),
                )
        files.close()
        columns = list(zip(*files.rows)) or [[]] * 5
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], ["part", "number", "file", "records", "ids"]
        )

    return run


def write(
    docs: DataFrame, tokenizer_path: str, doc_col: str = "doc_id", text_col: str = "text", end_id: int = 0,
    location: str | None = None,
) -> tuple[DataFrame, str]:
    """Writes the ids of all documents; the manifest and the folder it speaks of."""
    spark = docs.sparkSession
    text_batches(spark)
    location = location or work_dir(spark, "token-records")
    store, root = _open(location)
    store.create_dir(root, recursive=True)
    own = docs.select(docs[doc_col].cast("long").alias("doc"), docs[text_col].alias("text"))
    ordered = own.repartitionByRange("doc").sortWithinPartitions("doc", "text")
    return written(ordered.mapInArrow(_write(location, tokenizer_path, end_id), MANIFEST), "token-manifest"), location


def _read(location: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(location)
        for batch in batches:
            for file, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                with store.open_input_stream(posixpath.join(root, f"{file}.idx")) as index:
                    offsets = np.frombuffer(index.read(), "<u8")
                with store.open_input_stream(posixpath.join(root, f"{file}.rec")) as data:
                    records = unframed(data.read(), offsets)
                for at in range(0, len(records), 1_000):
                    rows = [parsed(r) for r in records[at : at + 1_000]]
                    sizes = np.array([len(ids) for _, ids in rows], np.int64)
                    starts = start + np.concatenate([[0], np.cumsum(sizes)])
                    out = [
                        pa.array([doc for doc, _ in rows], pa.int64()), pa.array(starts[:-1]), pa.array(sizes),
                        pa.array([zlib.crc32(ids.astype("<u4").tobytes()) for _, ids in rows], pa.int64()),
                    ]
                    names = ["doc", "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        out.append(pa.array([ids.astype(np.int64) for _, ids in rows], pa.list_(pa.int64())))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(out, names)
                    start = int(starts[-1])

    return run


def read(manifest: DataFrame, location: str, with_ids: bool = True) -> DataFrame:
    """``doc, start, n_tokens, ids_crc32`` and, if asked for, ``ids`` of every record, from the files."""
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    placed = manifest.select("file", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("start"))
    schema = "doc long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    files = manifest.count()  # one row a file; as many tasks, for adaptive execution would see tiny rows and take one
    return placed.repartition(max(1, min(files, MOST_TASKS)), "file").mapInArrow(_read(location, with_ids), schema)
