"""Quality rules, license scan, personal data, line dedup and decontamination."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tableferry.llm import decontaminate, license, line_dedup, pii, quality
from tableferry.llm.queries import QUERIES

from . import cases


def test_quality_measures_and_awkward_rows(spark):
    docs = cases.documents(spark)
    found = quality.judged(docs)
    cases.same_columns(found, docs)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for row in found.select("text", "quality.*").collect():
        assert tuple(row[n] for n in names) == cases.quality(row.text)
        assert row.base_failed == (row.n_words < 50 or 100 * row.n_repeat_words > 50 * row.n_words)
        assert row.kept == (not row.failed)
    assert quality.keep_good(docs).columns == docs.columns
    assert quality.judged(docs.limit(0)).count() == 0


def test_repeated_windows_against_brute_force(spark):
    chance = random.Random(3)
    texts = [" ".join(chance.choice("abc d ef".split()) for _ in range(chance.randint(0, 60))) for _ in range(200)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for row in quality.judged(docs).select("text", "quality.n_repeat_words").collect():
        assert row.n_repeat_words == cases.quality(row.text)[4]


def test_quality_query_keeps_every_row(spark, small):
    assert QUERIES["op10_quality_rules"](spark, small).count() == spark.read.parquet(f"{small}/documents.parquet").count()


def _license_base(text):
    words, places, labels = cases.plain_words(text), [], set()
    for phrase, label in license.PHRASES:
        own = phrase.split()
        for i in range(len(words) - len(own) + 1):
            if words[i : i + len(own)] == own:
                places.append(i)
                labels.add(label)
    return len(words), sorted(places), sorted(labels)


def test_license_phrases_and_findings(spark):
    texts = [
        "Licensed under the Apache License, Version 2.0 (the License)", "MIT license mit LICENSE", "cc-by-nc-sa 4.0, cc by cc by",
        "SPDX-License-Identifier: BSD-3-Clause", "GNU General Public License, version 3 or the GNU Lesser General Public License v2.1",
        "emit license; success by", "", None, "x " * 20_000 + "all rights reserved",
    ]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = {r.doc_id: r for r in license.scanned(docs).select("doc_id", "text", "license.*").collect()}
    for row in rows.values():
        n, places, labels = _license_base(row.text)
        assert (row.n_words, sorted(p.s for p in row.places)) == (n, places)
        assert set(labels) <= set(row.labels)
    assert rows[0].labels == ["apache", "apache-2.0"] and rows[0].score == 0.95
    assert [f.label for f in rows[0].findings] == ["apache-2.0"]  # the shorter findings lie inside
    assert "cc-by-nc-sa-4.0" in rows[2].labels
    assert rows[3].labels == ["bsd-3-clause"] and rows[3].score == 1.0
    assert {"gpl-3.0", "lgpl-2.1"} <= set(rows[4].labels)
    assert rows[5].labels == [] and rows[8].labels == ["proprietary"]
    awkward = cases.documents(spark)
    cases.same_columns(license.scanned(awkward), awkward)
    assert license.scanned(awkward.limit(0)).count() == 0


def test_license_keywords_are_in_every_match():
    """A rule's keyword must stand at a word's beginning in what the rule matches, else the gate would hide it."""
    for _, keyword, pattern, _ in license.RULES:
        plain = pattern
        while (shorter := re.sub(r"\((?:\?:)?[^()]*\)(?:\?|\{0,\d\}\??)", "", plain)) != plain:
            plain = shorter
        plain = re.sub(r"\((?:\?:)?([^()|]*)(?:\|[^()]*)?\)", r"\1", plain)
        plain = re.sub(r"\((?:\?:)?([^()|]*)(?:\|[^()]*)?\)", r"\1", plain)
        plain = re.sub(r" \?|\w\?", lambda m: "" if m[0] == " ?" else "", plain).replace("[cs]", "c")
        if re.fullmatch(pattern, plain):
            assert f" {keyword}" in f" {plain}", (keyword, pattern, plain)


BASE = {k: re.compile(v) for k, v in pii.BASE.items()}


def _pii(text):
    out = []
    for kind, pattern in BASE.items():
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            odd = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
            good = {
                "email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.group().split(".")),
                "card": 12 <= len(digits) <= 19 and sum(x - 9 * (x > 9) for x in odd) % 10 == 0, "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda x: (x[1], list(BASE).index(x[0])))


def test_personal_data_against_the_patterns():
    chance = random.Random(5)
    letters = "0123456789.. @@ab-+_%() é"
    for _ in range(20_000):
        text = "".join(chance.choice(letters) for _ in range(chance.randint(0, 40)))
        assert [x for x in pii.find(text) if x[0] in BASE] == _pii(text), text


def test_personal_data_from_cues():
    text = "IBAN: DE89 3704 0044 0532 0130 00, account no. 12345678; see https://ann:pw1@host.example/x"
    kinds = [(k, text[s:e]) for k, s, e in pii.find(text)]
    assert ("iban", "DE89 3704 0044 0532 0130 00") in kinds and ("account", "12345678") in kinds
    assert ("login_url", "ann:pw1@host.example") in kinds
    assert not [x for x in pii.find("IBAN DE89 3704 0044 0532 0130 01") if x[0] == "iban"]


def test_personal_data_columns(spark):
    docs = cases.documents(spark)
    cases.same_columns(pii.scanned(docs), docs)
    assert pii.scanned(docs.limit(0)).count() == 0
    mail = spark.createDataFrame([(1, "äö x@y.org, 1.2.3.4!"), (2, None), (3, "")], "doc_id long, text string")
    rows = [r.text for r in pii.redacted(mail).orderBy("doc_id").collect()]
    assert rows == ["äö <email>, <ip>!", None, ""]


def test_line_dedup(spark):
    pages = [("a", f"menu\nown text {i}\n\nmenu ") for i in range(20)] + [("b", "menu\nother")] * 30 + [(None, "x"), ("a", None), ("b", "")]
    docs = spark.createDataFrame([(i, h, t, "c", "d") for i, (h, t) in enumerate(pages)], "doc_id long, source string, text string, Host string, lines string")
    rows = {r.doc_id: r for r in line_dedup.without_boilerplate(docs, dropped_col="n_dropped").collect()}
    assert len(rows) == len(pages)
    assert all(rows[i].text == f"own text {i}\n" and rows[i].n_dropped == 2 for i in range(20))
    assert rows[20].text == "menu\nother"  # thirty copies are one page
    assert (rows[50].text, rows[51].text, rows[52].text) == ("x", None, "")
    assert line_dedup.without_boilerplate(docs).columns == docs.columns
    assert line_dedup.without_boilerplate(docs.limit(0)).count() == 0


def test_a_line_on_some_pages_of_a_host(spark):
    """On 8% of 100 pages it is boilerplate, on 4% it is not; a very long page and ties change nothing."""
    rows = []
    for i in range(100):
        lines = [f"page {i} is about {i * i}"] + ["Subscribe now"] * (i < 8) + ["Read more"] * (i >= 96) + ["Both"] * (20 <= i < 28)
        rows.append((i, "a", "\n".join(lines + ([cases.LONG] * 30 if i == 0 else []))))
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    found = {r.doc_id: r for r in line_dedup.without_boilerplate(docs, dropped_col="n").collect()}
    for doc, _, text in rows:
        kept = [x for x in text.split("\n") if x not in ("Subscribe now", "Both")]
        assert found[doc].text == "\n".join(kept) and found[doc].n == text.count("\n") + 1 - len(kept)


ITEMS = [
    (1, cases.SENTENCE), (2, "short item"), (2, "short item"), (3, None), (4, ""), (None, "lazy dog and runs"),
    (10, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"),
]


@pytest.mark.parametrize("few", [True, False])
def test_decontamination(spark, monkeypatch, few):
    if not few:  # the way beyond the broadcast's bound
        monkeypatch.setattr(decontaminate, "small_enough", lambda *a, **k: False)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    texts = [
        cases.SENTENCE + " more words here", "a short item, a SHORT item", "short", "", None, "the lazy dog and runs away",
        " ".join(["filler"] * 300) + " short item", ITEMS[-1][1] + " " + ITEMS[-1][1],
        "one two three four five six seven eight nine ten eleven twelve", cases.LONG + " " + cases.SENTENCE,
    ]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = decontaminate.scanned(docs, items, out="found")
    rows = found.select("doc_id", "text", "found.*", F.sha2(F.array_join("found.items", ","), 256).alias("d")).collect()
    items = [(i, t) for i, t in ITEMS if i is not None]
    for row in rows:
        expected = cases.contamination([(row.doc_id, row.text)], ITEMS)[0]
        named = cases.contamination([(row.doc_id, row.text)], items)[0]
        assert (row.n_words, row.n_hit, row.contaminated) == (expected[1], expected[2], expected[5])
        assert (len(row["items"]), row.d) == (named[3], named[4])


def test_decontamination_of_awkward_rows(spark):
    docs = cases.documents(spark)
    items = spark.createDataFrame(ITEMS[:1], "item_id long, text string")
    cases.same_columns(decontaminate.scanned(docs, items), docs)
    clean = decontaminate.without_contaminated(docs, items)
    assert clean.columns == docs.columns
    assert sorted(r.doc_id for r in clean.filter("doc_id is not null").collect()) == [3, 4, 5, 6, 7, 7, 8]
    assert decontaminate.scanned(docs.limit(0), items).count() == 0
    assert decontaminate.scanned(docs, items.limit(0)).filter("contamination.n_hit > 0").count() == 0
