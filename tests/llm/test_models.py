"""Near-duplicates, SentencePiece, token records, toxicity, secrets and the pipeline."""

from __future__ import annotations

import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tableferry.llm import arrow, neardup, secrets, sentencepiece, stored, token_records, toxicity
from tableferry.llm.queries import QUERIES, tokenizer_file

from . import cases


def _families(seed=1):
    """Families of edited copies without their original, chains, exact copies and single texts."""
    chance = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(4):
        base = [chance.choice(words) for _ in range(80)]
        for _ in range(25):
            own = list(base)
            for _ in range(chance.randint(1, 5)):
                own[chance.randrange(len(own))] = chance.choice(words)
            if chance.random() < 0.3:
                del own[: chance.randint(0, 12)]
            out.append(" ".join(own))
    chain = [chance.choice(words) for _ in range(60)]
    for k in range(12):  # each is like the next one, the ends are not alike
        out.append(" ".join(chain[k * 3 :] + [f"x{j}" for j in range(k * 3)]))
    out += [cases.SENTENCE] * 40 + ["", "", None, "one", "ONE", "two words", "Two\twords"]
    out += [" ".join(chance.choice(words) for _ in range(50)) for _ in range(60)]
    chance.shuffle(out)
    return [(i, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("size", [4, 5])
def test_groups_against_all_pairs(spark, size):
    rows = _families(size)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc: (r.n, r.part) for r in neardup.grouped(docs, size=size).collect()}
    assert found == cases.groups(rows, size)


def _templates(seed=2):
    """Pages of two templates: one leaves each page so little own text that it is near the centre, and no two are linked."""
    chance = random.Random(seed)
    often = [f"v{i}" for i in range(30)]
    out = []
    for base, own, count in ((80, 12, 150), (40, 50, 60)):
        page = [f"p{base}_{i}" for i in range(base)]
        for k in range(count):
            tail = [chance.choice(often) if chance.random() < 0.4 else f"u{base}_{k}_{i}" for i in range(own)]
            out.append(page + tail)
            if k % 10 == 0:  # a page that is linked with this one only, by what both add to the template
                out.append(page + tail[:-4] + [f"z{base}_{k}_{i}" for i in range(4)])
    chance.shuffle(out)
    return [(i, " ".join(words)) for i, words in enumerate(out)]


def test_members_of_a_template_are_not_compared_with_each_other(spark, monkeypatch):
    rows, counts = _templates(), {}

    def counted(table, purpose, *rest):
        out = stored.written(table, purpose, *rest)
        counts.setdefault(purpose, []).append(out.count())
        return out

    monkeypatch.setattr(neardup, "written", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc: (r.n, r.part) for r in neardup.grouped(docs, size=4).collect()}
    assert found == cases.groups(rows, 4)
    assert sum(counts["residue"]) <= 20 * len(rows)  # the hubs' pairs and few more; all pairs are some 13,000


def test_estimates_follow_the_similarity():
    chance = np.random.default_rng(5)
    pool = chance.integers(0, 1 << 63, 2_000, dtype=np.uint64)
    for shared in (0.2, 0.5, 0.8):
        a, b = pool[:1_000], np.concatenate([pool[: int(1_000 * shared)], pool[1_000 : 2_000 - int(1_000 * shared)]])
        x, y = neardup.sketch(a).astype(int), neardup.sketch(b).astype(int)
        n = np.array([1_000.0])
        found = neardup.estimate(np.array([(x > y).sum()]), np.array([(x < y).sum()]), n, n)[0]
        assert abs(found - shared / (2 - shared)) < 0.2
    merged = np.maximum(neardup.sketch(a), neardup.sketch(b))
    assert (merged == neardup.sketch(np.unique(np.concatenate([a, b])))).all()


def test_groups_of_awkward_rows(spark):
    docs = cases.documents(spark)
    rows = neardup.grouped(docs).collect()
    assert len(rows) == len(cases.ROWS)
    parts = {r.doc: r.part for r in rows}
    assert parts[2] == 1 and parts[3] == 3 and parts[4] == 4 and parts[7] == 7
    kept = neardup.first_of_each_group(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in cases.ROWS if r[0] != 2)
    assert neardup.grouped(docs.limit(0)).count() == 0


def test_near_duplicate_query(spark, small):
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    expected = cases.groups(docs, 4)
    rows = QUERIES["op7_near_duplicates"](spark, small).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


@pytest.fixture(scope="module")
def pieces():
    return tokenizer_file("piece_bpe_32k.model")


LETTERS = "aeinrsto  thé▁ñ漢😀\n\t.,01-AB   "


def _random_texts(n, seed=3):
    chance = random.Random(seed)
    return ["".join(chance.choice(LETTERS) for _ in range(chance.randint(0, 30))) for _ in range(n)]


def test_ids_are_those_of_the_library(pieces, small):
    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=pieces)
    own = sentencepiece.Tokenizer(pieces)
    for text in [*_random_texts(3_000), cases.LONG, "a" * 5_000, *(r[1] for r in cases.ROWS if r[1])]:
        ids = own.encode(text).tolist()
        assert ids == library.encode(text)
        assert own.decode(ids) == library.decode(ids) == text.replace("▁", " ")


def test_kept_words_are_bounded(pieces):
    own = sentencepiece.Tokenizer(pieces)
    letters = "etaoinshrdlucm"
    words = ["".join(letters[k // 14**j % 14] for j in range(5)) for k in range(14**5)]
    for at in range(0, len(words), 10_000):
        own.encode_batch([" ".join(words[at : at + 10_000])])
        assert len(own.words) + len(own.old_words) + len(own.units) <= 600_000  # twice as many before


def _remarked(path, target, kind):
    """The same pieces and scores, marked as another kind of model."""

    def number(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    data = b""
    for field, value in sentencepiece._fields(open(path, "rb").read()):
        if field == 2:  # a trainer's record of the kind and of byte pieces alone
            value = number(3 << 3) + number(kind) + number(35 << 3) + number(1)
        data += number(field << 3 | 2) + number(len(value)) + value
    target.write_bytes(data)
    return str(target)


def test_round_trip_in_one_pass(spark, pieces):
    docs = cases.documents(spark)
    found = sentencepiece.with_round_trip(docs, pieces, out="n_words")
    cases.same_columns(found, docs)
    own = sentencepiece.Tokenizer(pieces)
    assert all(r.n_words_.ids == own.encode(r.text).tolist() and r.n_words_.restored for r in found.collect())
    odd = spark.createDataFrame([("a ▁ b",)], "text string")  # the format's own sign for a blank comes back as one
    assert not sentencepiece.with_round_trip(odd, pieces).first().encoded.restored
    assert sentencepiece.with_round_trip(docs.limit(0), pieces).count() == 0


def test_sentencepiece_query(spark, small, pieces):
    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=pieces)
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    expected = sorted((r.doc_id, len(ids), ids, library.decode(ids) == r.text) for r in rows for ids in [library.encode(r.text)])
    assert sorted(map(tuple, QUERIES["op1_sentencepiece"](spark, small).collect())) == expected


def test_unigram_paths_are_those_of_the_library(pieces, tmp_path):
    path = _remarked(pieces, tmp_path / "unigram.model", sentencepiece.UNIGRAM)
    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=path)
    own = sentencepiece.Tokenizer(path)
    for text in _random_texts(2_000, 4):
        if own.chars.issuperset(text.replace(" ", "▁")):  # of paths with equal scores either may come
            ids, others = own.encode(text).tolist(), library.encode(text)
            assert sum(own.scores[i] for i in ids) == sum(own.scores[i] for i in others)
            assert own.decode(ids) == library.decode(others)


def test_round_trip_in_tables(spark, pieces):
    docs = cases.documents(spark)
    ids = sentencepiece.with_ids(docs, pieces)
    cases.same_columns(ids, docs)
    rows = sentencepiece.with_text(ids, pieces).collect()
    assert all(r.decoded == (r.text or "") for r in rows)
    assert sentencepiece.with_ids(docs.limit(0), pieces).count() == 0


def _plain_sum(data):
    state = 0xFFFFFFFF
    for byte in data:
        state ^= byte
        for _ in range(8):
            state = (state >> 1) ^ (0x82F63B78 if state & 1 else 0)
    state ^= 0xFFFFFFFF
    return ((state >> 15 | state << 17) + 0xA282EAD8) & 0xFFFFFFFF


def test_records_and_their_checksums():
    chance = random.Random(1)
    payloads = [chance.randbytes(chance.choice([4, 9, 100, 511, 512, 513, 1_500])) for _ in range(40)]
    data, offsets = token_records.framed(payloads)
    for payload, at in zip(payloads, offsets):
        size, head = struct.unpack("<QI", data[at : at + 12])
        assert (size, head) == (len(payload), _plain_sum(data[at : at + 8]))
        assert struct.unpack("<I", data[at + 12 + size : at + 16 + size])[0] == _plain_sum(payload)
    assert token_records.unframed(data, offsets) == payloads
    assert token_records.unframed(data, offsets[::-1]) == payloads[::-1]  # shuffled reads
    broken = bytearray(data)
    broken[offsets[3] + 14] ^= 1
    with pytest.raises(ValueError):
        token_records.unframed(bytes(broken), offsets)
    with pytest.raises(ValueError):
        token_records.unframed(bytes([data[0] ^ 1]) + data[1:], offsets)


def _expected_ids(rows):
    tokenizers = pytest.importorskip("tokenizers")
    own = tokenizers.Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    at, out = 0, []
    for doc, text in rows:
        ids = [*own.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        at += len(ids)
    return out


def test_stretches_are_encoded_as_in_the_whole_text():
    own = token_records.Encoder(tokenizer_file("byte_bpe_50k.json"))
    texts = [t.replace("▁", chance) for chance in ("\n", "\u00a0", "'s", " ") for t in _random_texts(2_000, 9)]
    texts += [cases.LONG, "", " ", "  ", " a", "a ", "<|endoftext|> a", "\n b \n\n c", "a <|endoftext|> b", "a<|endoftext|>b c"]
    texts += ["a word. a word, a word a word.\" (a word) it's. isn't, \u00e9. x\u0301, 1. 2.5) ...) !? a's!'s b'. c.'d word.)]}:;"]
    texts += ["".join(chance) for chance in zip(*[iter(random.Random(8).choices("ab .,;:!?)]}\"'s\u00e91\n", k=12_000))] * 12)]
    texts += ["\na b", "a\n b", "a b\n", "a \nb", "a\nb c", "<|endoftext|", "x <|endoftext|><|endoftext|> y z"]
    for _ in range(2):  # cold and cached
        found = [np.frombuffer(x, "<u2").tolist() for x in own.encode(texts)]
        assert found == [x[4] for x in _expected_ids([(0, t) for t in texts])]


def test_tokens_that_cross_blanks_are_kept():
    own = token_records.Encoder(tokenizer_file("byte_bpe_50k.json"))
    spaces = ["\u00a0", "\t", "\n", "\u2003", "\u3000", "\x85", "\x1c"]
    texts = ["a" + f" {x}" * n + tail for x in spaces for n in range(1, 18) for tail in (" b", "b", " ", "")]
    texts += ["a" + f"{x} " * n + "b c" for x in spaces for n in range(1, 18)]
    for _ in range(2):  # cold and cached
        found = [np.frombuffer(x, "<u2").tolist() for x in own.encode(texts)]
        assert found == [x[4] for x in _expected_ids([(0, t) for t in texts])]


def test_token_records_of_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(token_records, "FILE_BYTES", 400)  # several files a task (local workers are forked)
    docs = cases.documents(spark)
    manifest, location = token_records.write(docs, tokenizer_file("byte_bpe_50k.json"))
    rows = token_records.read(manifest, location).collect()
    order = sorted(((r[0], r[1]) for r in cases.ROWS), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    found = sorted(((r.doc, r.start, r.n_tokens, r.ids_crc32, r.ids) for r in rows), key=lambda x: x[1])
    assert found == _expected_ids(order)
    manifest, location = token_records.write(docs.limit(0), tokenizer_file("byte_bpe_50k.json"))
    assert token_records.read(manifest, location).count() == 0


def test_token_record_query(spark, small):
    rows = sorted(tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect())
    found = QUERIES["op8_token_records"](spark, small).orderBy("doc_id").collect()
    assert [tuple(r) for r in found] == [x[:4] for x in _expected_ids(rows)]


def test_toxicity_finds_sentences():
    chance = random.Random(2)
    calm = [f"calm{i}" for i in range(60)]
    bags, labels, bad = [], [], []
    for i in range(600):
        lines = [" ".join(chance.choice(calm) for _ in range(8)) for _ in range(chance.randint(1, 12))]
        if i % 3 == 0:
            lines[chance.randrange(len(lines))] += " " + chance.choice(["nasty", "horrid", "vileness"])
        text = ". ".join(lines)
        bags.append(toxicity.sentences(text))
        labels.append(int(i % 3 == 0))
        bad.append(text)
    names = sorted({w for b in bags for s in b for w in s})
    words, sizes = zip(*[toxicity.coded(b, {w: i for i, w in enumerate(names)}) for b in bags])
    table = pa.table({
        "label": pa.array(labels, pa.int32()), "words": pa.array(words, pa.list_(pa.int32())),
        "sizes": pa.array(sizes, pa.list_(pa.int32())),
    })
    model = toxicity.fit(names, table)
    right = [int(toxicity.score(t, model)["score"] >= 0.5) == y for t, y in zip(bad, labels)]
    assert sum(right) / len(right) > 0.99
    found = toxicity.score("calm1 calm2. calm3 nasty calm4. calm5", model)
    assert [s["sentence"] for s in found["sentences"]] == [1]
    assert toxicity.score(None, model) == toxicity.score("", model) == {"score": 0.0, "sentences": []}
    assert toxicity.fit(names, table.slice(1, 1)).words == {}


def test_toxicity_columns(spark):
    docs = cases.documents(spark)
    labels = spark.createDataFrame([(1, 1), (1, None), (6, 0), (None, 1)], "doc_id long, toxic int")
    found = toxicity.scanned(docs, toxicity.trained(docs, labels))
    cases.same_columns(found, docs)
    assert found.filter("toxicity.score < 0 or toxicity.score > 1").count() == 0
    assert toxicity.scanned(docs.limit(0), toxicity.trained(docs, labels.limit(0))).count() == 0


def test_toxicity_does_not_depend_on_the_sample_cap(spark, monkeypatch):
    """The word is in all toxic documents and in as many clean ones as make its documents 30% toxic."""
    rows = [(i, "plain words and " + ("doubtful" if i < 500 else "calm"), int(i < 150)) for i in range(2_000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    docs, labels = table.select("doc_id", "text"), table.select("doc_id", "toxic")
    found = []
    for cap in (2_000, 150):  # nothing sampled; clean documents sampled at 150 of 1,850
        monkeypatch.setattr(toxicity, "SAMPLE_DOCS", cap)
        model = toxicity.trained(docs, labels)
        found.append(toxicity.score("plain words and doubtful", model)["score"])
    assert 0.2 < found[0] < 0.4 and abs(found[0] - found[1]) < 0.15


def test_secret_scan(spark):
    chance = random.Random(4)
    rows = []
    for i in range(120):
        key = "".join(chance.choice("0123456789abcdef") for _ in range(40))
        number = "".join(chance.choice("0123456789") for _ in range(16))
        rows.append((i, f'plain words and {number} then text. token = "{key}" more words'))
    rows += [(200, None), (201, ""), (202, 'key = "EXAMPLE0123456789abcdef"'), (None, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = [r for r in secrets.scanned(docs).collect() if r.probability >= 0.5]
    texts = dict(rows)
    assert len(found) == 121
    assert all(texts[r.doc][r.start - 9 : r.start] == 'token = "' for r in found)
    assert secrets.scanned(docs.limit(0)).count() == 0


def test_pipeline(spark, small):
    rows = corpus_pipeline.run(spark, small).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    good = {i for i, r in docs.items() if cases.quality(r.text)[0] >= 50}
    assert 0 < len(rows) <= len(good) and {r.doc_id for r in rows} <= good
    assert all(r.restored and r.n_tokens == len(r.ids) and r.n_chars == len(r.text) for r in rows)
    items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]
    assert not any(x[5] for x in cases.contamination([(r.doc_id, r.text) for r in rows], items))
    parts = cases.groups([(r.doc_id, r.text) for r in rows], 5)
    assert all(part == doc for doc, (n, part) in parts.items())


def test_pipeline_drops_a_line_on_some_pages_of_a_source(spark, small):
    """A boilerplate line on 8% of a source's 100 pages goes, one on 4% of them stays."""
    rows = []
    for i in range(100):
        lines = [f"page {i} is about {i * i}"] + ["Subscribe now"] * (i < 8) + ["Read more"] * (i >= 96)
        rows.append((i, "\n".join(lines), "en", "a", 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    found = {r.doc_id: r for r in dict(corpus_pipeline.STAGES)["line_dedup"](spark, docs, small).collect()}
    assert all(found[r[0]].text == r[1].replace("\nSubscribe now", "") for r in rows)
    assert all(r.n_chars == len(r.text) for r in found.values())


def test_pipeline_stages_keep_the_columns(spark, small):
    docs = cases.documents(spark)
    for table in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, table, small).columns == docs.columns
            stage(spark, table, small).count()
        assert corpus_pipeline.STAGES[-1][1](spark, table, small).count() == table.count()


def test_pipeline_stages_bound_the_texts_held_at_once(spark, small):
    """Every stage, also alone: 128 rows of a file and, for encoding, 250 texts; a lower setting stays."""
    before = {key: spark.conf.get(key) for key in (arrow.READ, arrow.ROWS, arrow.BYTES)}
    try:
        for _, stage in corpus_pipeline.STAGES:
            spark.conf.set(arrow.READ, "4096")
            stage(spark, cases.documents(spark), small)
            assert spark.conf.get(arrow.READ) == "128"
        assert spark.conf.get(arrow.ROWS) == "250"
        arrow.text_reads(spark, 256)
        assert spark.conf.get(arrow.READ) == "128"
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
