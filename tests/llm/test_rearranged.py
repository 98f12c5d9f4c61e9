"""Fill-in-the-middle, the Merkle manifest and BPE ids against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
import string
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tableferry.llm import bpe, fim, merkle
from tableferry.llm.queries import QUERIES, tokenizer_file

from . import cases

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def _middle(doc, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def _sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


@pytest.mark.parametrize("window", [fim.WINDOW, 7])
def test_middles_against_a_plain_version(spark, monkeypatch, window):
    monkeypatch.setattr(fim, "WINDOW", window)
    chance = random.Random(1)
    parts = ["a", "b ", " ", "\n", "é", "漢", "<", "P", ">", "<S>", "<M", "x" * 5, "\x1c", " "]
    rows = [(i, "".join(chance.choice(parts) for _ in range(chance.randint(0, 40)))) for i in range(1_500)]
    rows += [(None, "a b c"), (5_000, None), (5_001, ""), (5_002, " \n"), (5_003, "x y " * 20_000)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = fim.transformed(docs)
    names = ("n", "form", "prefix_chars", "middle_chars", "output")
    both = fim.restored(made, made["fim"]["output"], made["fim"]["form"]).collect()
    found = [(r.doc_id, r.text, tuple(r.fim[k] for k in names), r.restored) for r in both]
    assert sorted(found, key=repr) == sorted(((d, t, _middle(d, t), t or "") for d, t in rows), key=repr)


def test_shifts_follow_the_pieces():
    first, shift = np.array([0, 3, 3, 10]), np.array([5, 9, -1, 100])
    for window in (fim.WINDOW, 4):
        fim.WINDOW, before = window, fim.WINDOW
        target = np.concatenate([t for _, t in fim._shifts(first, shift, 12)])
        fim.WINDOW = before
        assert target.tolist() == [5, 6, 7, 2, 3, 4, 5, 6, 7, 8, 110, 111]  # of two runs at one place the last counts


def test_middles_of_awkward_rows(spark):
    docs = cases.documents(spark)
    cases.same_columns(fim.transformed(docs, out="n_words"), docs)
    assert fim.transformed(docs.limit(0)).count() == 0


def test_fill_in_middle_query(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    expected = []
    for r in rows:
        n, form, a, b, output = _middle(r.doc_id, r.text)
        expected.append((r.doc_id, n, form, a, b, _sha(output), _sha(r.text or "")))
    found = QUERIES["op11_fill_in_middle"](spark, small).collect()
    assert sorted(map(tuple, found)) == sorted(expected) and len({r.form for r in found}) == 3


def _leaf(row):
    return _sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def _levels(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([_sha(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def _beside(levels, at):
    for level in levels[:-1]:
        first = at // 16 * 16
        yield level[first:at], level[at + 1 : first + 16]
        at //= 16


def _verified(rows):
    """All rows of the check, one fold per document from scratch."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r)))
    trees = [_levels([_leaf(r) for r in groups[s]]) for s in order]
    top, lower = _levels([t[-1][0] for t in trees]), str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    out = []
    for k, s in enumerate(order):
        for i, r in enumerate(groups[s]):
            beside, other = [*_beside(trees[k], i), *_beside(top, k)], r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                other = (*r[:4], r[4].translate(lower))
            digest = _leaf(other)
            for left, right in beside:
                digest = _sha(*left, digest, *right)
            proof = [x for left, right in beside for x in (*left, *right)]
            root = top[-1][0]
            out.append((r[0], _leaf(r), trees[k][-1][0], root, _sha(*proof), digest, digest == root, tuple(proof)))
    return sorted(out, key=repr)


def _changed(own):
    lower = F.translate(own["text"], string.ascii_uppercase, string.ascii_lowercase)
    return F.crc32(own["doc_id"].cast("string")) % 5 == 0, {"text": lower}


def _found(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string, tree int, pos int")
    manifest = merkle.built(docs, COLUMNS, changed=_changed)
    return manifest, sorted(((*r[:7], tuple(r[7])) for r in merkle.verified(manifest, with_proof=True).collect()), key=repr)


def test_merkle_trees_against_a_plain_version(spark):
    chance = random.Random(1)
    rows = [(i, chance.choice(["a", "b", None, "é", "", "zz"]), "en", i, f"Some Text {i}" if i % 3 else "low") for i in range(600)]
    rows += [(i, "big", "en", i, "T") for i in range(10_000, 14_500)]  # more than one block
    rows += [(None, "a", None, None, None)] * 2 + [(3, "a", "en", 1, "X")] * 3 + [(4, "a", "en", 1, cases.LONG)]
    manifest, found = _found(spark, [(*r, 1, 2) for r in rows])
    assert found == _verified(rows)
    assert any(not r[6] for r in found) and len(manifest.steps) == 3


@pytest.mark.parametrize("rows", [
    [], [(1, "a", "en", 1, "Abc")], [(i, str(i), "en", 1, "Abc") for i in range(40)], [(i, None, "en", 1, "Abc") for i in range(17)],
])
def test_small_merkle_trees(spark, rows):
    assert _found(spark, [(*r, 1, 2) for r in rows])[1] == (_verified(rows) if rows else [])



def test_folding_resumes_the_state_before_a_slot():
    digests = [_sha(str(i)) for i in range(700)]
    tree = merkle.Midstates(digests, merkle.levels_above(700))
    assert tree.rows[-1].decode() == _levels(digests)[-1][0]
    for slot in (0, 15, 16, 300, 699):
        own = list(digests)
        own[slot] = _sha("other")
        assert tree.folded(slot, own[slot].encode()).decode() == _levels(own)[-1][0]
        assert tree.folded(slot, digests[slot].encode()) == tree.rows[-1]


def test_merkle_query(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select(*COLUMNS).collect()]
    found = QUERIES["op12_merkle_manifest"](spark, small).collect()
    assert sorted(map(tuple, found), key=repr) == [r[:7] for r in _verified(rows)]


@pytest.fixture(scope="module")
def words():
    return tokenizer_file("word_bpe_49k.json")


PARTS = ["a", "B", "é,", "İ,", "Ö!", "ǅ.", "÷,", "×1", "the", "The", "'s", "'LL", " ", "  ", "\n", "é", "é", "H̱", "ẖ", "İ", "İ", "Σ", "ς", "K", "漢", "😀",
         ".", ",", "1", "23", "½", "\x1c", "\x85", " ", "　", "​", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|",
         "|>", "<", "=", "̸", "-", "_", "ä", "\x00", "ſ", "ﬁ", "x-y", "\t", "word7"]


def _ids(path, rows):
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(path)
    out = []
    for doc, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        out.append((doc, ids, library.decode(ids, skip_special_tokens=False)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("size", [bpe.BLOCK_BYTES, 3_000])
def test_word_ids_are_those_of_the_library(spark, words, monkeypatch, size):
    monkeypatch.setattr(bpe, "BLOCK_BYTES", size)  # the second: many blocks
    chance = random.Random(1)
    rows = [(i, "".join(chance.choice(PARTS) for _ in range(chance.randint(0, 25)))) for i in range(2_500)]
    rows += [(None, "a b c"), (5, None), (6, "")] + [(7, cases.LONG)] * 2 + [(r[0], r[1]) for r in cases.ROWS]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = bpe.decoded(bpe.encoded(docs, words, keep=["doc_id"]), words, out="back")
    assert sorted(((r.doc_id, r.ids, r.back) for r in found.collect()), key=repr) == _ids(words, rows)


def test_packed_numbers():
    numbers = np.array([0, 1, 127, 128, 16_383, 16_384, 2**21 - 1, 2**21, 2**28 - 1, 2**28, 2**31 - 1], np.int64)
    for own in (numbers, numbers[::-1], numbers[:0]):
        data, ends = bpe.packed(own)
        found, until = bpe.unpacked(data)
        assert found.tolist() == own.tolist() and until.tolist() == ends.tolist()


def test_each_distinct_word_is_encoded_once(spark, words):
    """The words' exchange is one, shared by the distinct words and the way back, and nothing is multiplied."""
    docs = spark.createDataFrame([(i, "one two three") for i in range(50)], "doc_id long, text string")
    plan = bpe.encoded(docs, words)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "NestedLoop" not in plan and "Cartesian" not in plan


def test_word_ids_of_awkward_rows(spark, words):
    docs = cases.documents(spark).withColumn("ids", F.lit(1)).withColumn("block", F.lit(2)).withColumn("word", F.lit("x"))
    found = bpe.encoded(docs, words)
    assert found.columns == [*docs.columns, "ids_"]
    assert sorted(map(repr, found.select(*docs.columns).collect())) == sorted(map(repr, docs.collect()))
    assert bpe.encoded(docs.limit(0), words).count() == 0
    ids = spark.createDataFrame([(1, None), (2, []), (3, [999_999, 320, None, -1]), (4, [320])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in bpe.decoded(ids, words).collect()} == {1: None, 2: "", 3: "a</w>", 4: "a</w>"}


def test_files_of_another_kind_are_refused():
    with pytest.raises(ValueError):
        bpe.Vocabulary(tokenizer_file("byte_bpe_50k.json"))


def test_bpe_query(spark, small, words):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    expected = [(d, len(ids), _sha(" ".join(map(str, ids))), _sha(back)) for d, ids, back in _ids(words, rows)]
    assert sorted(map(tuple, QUERIES["op13_bpe"](spark, small).collect())) == sorted(expected)
