"""Registered queries of the operators, with checking SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, fim, line_dedup, merkle, neardup, pii, quality, secrets, sentencepiece, token_records, toxicity
from . import license as license_scan
from .text import ascii_lower

WORDS_SQL = (
    "list_filter(string_split_regex(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
    "'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"
)
BLANK_WORDS_SQL = "list_filter(string_split_regex(coalesce({0}, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """Where the public vocabulary files lie; they are installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    both = sentencepiece.with_round_trip(docs, tokenizer_file("piece_bpe_32k.model"), out="encoded")
    ids = F.col("encoded")["ids"]
    return both.select(
        "doc_id", F.size(ids).cast("long").alias("n_tokens"), ids.alias("ids"), F.col("encoded")["restored"].alias("restored")
    )


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    found = decontaminate.scanned(docs, _table(spark, sf_dir, "benchmark"), out="found")
    hit = F.col("found")
    return found.select(
        "doc_id",
        hit["n_words"].alias("n_words"),
        hit["n_hit"].alias("n_hit"),
        F.size(hit["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(hit["items"], ","), 256).alias("items_sha256"),
        hit["contaminated"].alias("contaminated"),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", "source", "text")
    return line_dedup.without_boilerplate(docs, dropped_col="n_dropped")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.scanned(_docs(spark, sf_dir).select("doc_id", "text"), out="spans")
    spans = F.col("spans")

    def number(kind):
        return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(own):
        return F.array_join(F.transform(own, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    return found.select(
        "doc_id",
        *[number(k) for k in pii.BASE],
        F.sha2(joined(F.filter(spans, lambda x: x["kind"].isin(*pii.BASE))), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
    )


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scanned(_docs(spark, sf_dir).select("doc_id", "text"))
    return found.filter(F.col("probability") >= 0.5).select(
        F.col("doc").alias("doc_id"), "start", "end", F.round("probability", 6).alias("probability")
    )


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))
    labels = _table(spark, sf_dir, "labels").filter(~held_out)
    found = toxicity.scanned(docs, toxicity.trained(docs, labels), out="found")
    score = F.col("found")["score"]
    return found.select(
        "doc_id", held_out.alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted")
    )


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    found = neardup.grouped(docs, size=4, similarity=0.8)
    return found.select(
        F.col("doc").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.col("part").alias("component_id"),
        F.coalesce(F.col("doc") == F.col("part"), F.lit(True)).alias("kept"),
    )


def op8_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest, location = token_records.write(
        _docs(spark, sf_dir).select("doc_id", "text"), tokenizer_file("byte_bpe_50k.json")
    )
    return token_records.read(manifest, location, with_ids=False).withColumnRenamed("doc", "doc_id")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scanned(_docs(spark, sf_dir).select("doc_id", "text"), out="found")
    places = F.col("found")["places"]
    base = F.array_sort(F.array_distinct(F.transform(places, lambda x: x["label"])))
    return found.select(
        "doc_id",
        F.col("found")["n_words"].alias("n_words"),
        F.size(places).cast("long").alias("n_base"),
        F.array_min(F.transform(places, lambda x: x["s"])).cast("long").alias("first_word"),
        F.array_max(F.transform(places, lambda x: x["s"])).cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.col("found")["labels"], ",").alias("labels"),
        F.col("found")["score"].alias("score"),
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judged(_docs(spark, sf_dir).select("doc_id", "text"), out="q")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged.select("doc_id", *[F.col("q")[n].alias(n) for n in names])


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transformed(_docs(spark, sf_dir).select("doc_id", "text"), out="made")
    both = fim.restored(made, made["made"]["output"], made["made"]["form"])
    own = F.col("made")
    return both.select(
        "doc_id",
        *[own[c].alias(c) for c in ("n", "form", "prefix_chars", "middle_chars")],
        F.sha2(own["output"], 256).alias("output_sha256"),
        F.sha2("restored", 256).alias("restored_sha256"),
    )


def _lower_some(own: dict[str, Column]) -> tuple[Column, dict[str, Column]]:
    """Texts in lower case where the checksum of the id is a multiple of five."""
    return F.crc32(own["doc_id"].cast("string")) % 5 == 0, {"text": ascii_lower(own["text"])}


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    manifest = merkle.built(_docs(spark, sf_dir).select(*columns), columns, changed=_lower_some)
    return merkle.verified(manifest).withColumnRenamed("doc", "doc_id")


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_file("word_bpe_49k.json")
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    found = bpe.decoded(bpe.encoded(docs, path, keep=["doc_id"]), path)
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


OP10_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, {BLANK_WORDS_SQL.format('t')} AS ws FROM d),
grams AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
          FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
repeated AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM grams) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM repeated) GROUP BY r),
lines AS (SELECT r, count(*) AS n, count(*) - count(DISTINCT l) AS dup
          FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d)
          WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY r),
m AS (SELECT doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g'))) AS n_symbols,
             coalesce(lines.dup, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
             coalesce(lines.n, 0) AS n_lines,
             len(list_intersect(list_distinct(ws), [{', '.join(f"'{x}'" for x in sorted(set(quality.STOP_WORDS)))}])) AS n_stop
      FROM w LEFT JOIN covered USING (r) LEFT JOIN lines USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words
            OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR n_symbols > 0.1 * word_chars
            OR n_dup_lines > 0.5 * n_lines OR n_stop < 2) AS kept
FROM m
"""

OP2_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS_SQL.format('text')} AS ws FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {WORDS_SQL.format('text')} AS ws FROM benchmark),
win AS (SELECT item, array_to_string(ws[i:i + 12], ' ') AS g, least(len(ws), 13) AS n
        FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (SELECT r, i, n, array_to_string(ws[i:i + n - 1], ' ') AS g
       FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes)),
hits AS (SELECT r, i, n, item FROM grams JOIN win USING (g, n)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS l FROM hits GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
       sha256(coalesce(items.l, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""

OP3_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text FROM documents),
totals AS (SELECT source, count(DISTINCT text) AS n FROM d GROUP BY source),
lines AS (SELECT r, source, text, trim(unnest(string_split(text, chr(10))), ' ' || chr(9) || chr(13)) AS l FROM d),
bad AS (SELECT source, l FROM (SELECT source, l, count(DISTINCT text) AS n FROM lines WHERE l <> '' GROUP BY source, l) c
        JOIN totals t USING (source) WHERE c.n >= {line_dedup.MIN_PAGES} AND c.n > {line_dedup.RATIO} * t.n),
lists AS (SELECT source, list(l) AS ls FROM bad GROUP BY source),
cut AS (SELECT doc_id, source, text, ls, string_split(text, chr(10)) AS own,
               list_filter(string_split(text, chr(10)),
                           lambda x: NOT list_contains(ls, trim(x, ' ' || chr(9) || chr(13)))) AS stays
        FROM d LEFT JOIN lists USING (source))
SELECT doc_id, source, CASE WHEN text IS NULL OR ls IS NULL THEN text ELSE array_to_string(stays, chr(10)) END AS text,
       (CASE WHEN text IS NULL OR ls IS NULL THEN 0 ELSE len(own) - len(stays) END)::BIGINT AS n_dropped
FROM cut
"""

def _group_sql(draw: int) -> str:
    return f"('0x' || substr(h, {8 * draw + 1}, 8))::BIGINT"


OP11_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
                  regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS u
           FROM documents),
cut AS (SELECT *, len(u) AS n, {_group_sql(0)} % (len(u) + 1) AS a, {_group_sql(1)} % (len(u) + 1) AS b,
               CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                         OR {_group_sql(2)} % 100 >= 50 THEN 'plain'
                    WHEN {_group_sql(3)} % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
parts AS (SELECT *, array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m,
                 array_to_string(u[greatest(a, b) + 1:], '') AS s FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m
                        ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""


def _crc_sql(value: str) -> str:
    """CRC-32 of a short ASCII text; the table by byte is made from the polynomial."""
    table = []
    for byte in range(256):
        for _ in range(8):
            byte = (byte >> 1) ^ (0xEDB88320 if byte & 1 else 0)
        table.append(byte)
    return (
        f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({value}, ''), lambda x: ascii(x)::BIGINT)), "
        f"lambda c, b: xor(c >> 8, ([{', '.join(map(str, table))}]::BIGINT[])[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"
    )


def _leaf_sql(text: str) -> str:
    fields = [f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(fields)})"


def _op12_sql(levels: int = 5) -> str:
    """Trees of at most 16 ** ``levels`` leaves, one level after the other.

    ``l0`` holds the leaves of all groups; a group of one node stays as it is, so each ends with its root at the last level.
    The same steps then run over the roots. ``w`` walks up from every document with its folded digest and siblings.
    """
    steps = [
        "d AS (SELECT row_number() OVER () AS r, *, lower_text.t AS t2 FROM documents, LATERAL (SELECT "
        "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t) lower_text)",
        f"h AS (SELECT r, doc_id, source AS tree, {_leaf_sql('text')} AS leaf, "
        f"CASE WHEN {_crc_sql('doc_id::VARCHAR')} % 5 = 0 THEN {_leaf_sql('t2')} END AS changed FROM d)",
        "p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS pos FROM h)",
        "a0 AS (SELECT tree, pos, leaf AS digest, count(*) OVER (PARTITION BY tree) AS n FROM p)",
        "wa0 AS (SELECT r, tree, pos, coalesce(changed, leaf) AS folded, '' AS siblings FROM p)",
    ]

    def climb(name: str) -> None:
        for k in range(levels):
            now, up = f"{name}{k}", f"{name}{k + 1}"
            steps.append(
                f"{up} AS (SELECT tree, pos // 16 AS pos, CASE WHEN n > 1 THEN sha256(string_agg(digest, '' ORDER BY pos)) "
                f"ELSE min(digest) END AS digest, (n + 15) // 16 AS n FROM {now} GROUP BY tree, n, pos // 16)"
            )
            steps.append(
                f"w{up} AS (SELECT w.r, w.tree, w.pos // 16 AS pos, CASE WHEN any_value(c.n) > 1 THEN sha256(string_agg("
                f"CASE WHEN c.pos = w.pos THEN w.folded ELSE c.digest END, '' ORDER BY c.pos)) ELSE w.folded END AS folded, "
                f"w.siblings || coalesce(string_agg(c.digest, '' ORDER BY c.pos) FILTER (WHERE c.pos <> w.pos), '') AS siblings "
                f"FROM w{now} w JOIN {now} c ON c.tree IS NOT DISTINCT FROM w.tree AND c.pos // 16 = w.pos // 16 "
                f"GROUP BY w.r, w.tree, w.pos, w.folded, w.siblings)"
            )

    climb("a")
    steps += [
        f"roots AS (SELECT tree AS name, digest, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS pos, "
        f"count(*) OVER () AS n FROM a{levels})",
        "b0 AS (SELECT '' AS tree, pos, digest, n FROM roots)",
        f"wb0 AS (SELECT w.r, '' AS tree, roots.pos, w.folded, w.siblings FROM wa{levels} w "
        "JOIN roots ON roots.name IS NOT DISTINCT FROM w.tree)",
    ]
    climb("b")
    return (
        f"WITH {', '.join(steps)} SELECT h.doc_id, h.leaf, roots.digest AS subroot, top.digest AS root, sha256(w.siblings) AS proof_sha256, "
        f"w.folded AS folded_root, w.folded = top.digest AS verified FROM h JOIN wb{levels} w USING (r) "
        f"JOIN roots ON roots.name IS NOT DISTINCT FROM h.tree, b{levels} top"
    )


QUERIES = {"op1_sentencepiece": op1_sentencepiece, "op2_decontamination": op2_decontamination, "op3_line_dedup": op3_line_dedup, "op4_pii": op4_pii, "op5_secret_scan": op5_secret_scan, "op6_toxicity": op6_toxicity, "op7_near_duplicates": op7_near_duplicates, "op8_token_records": op8_token_records, "op9_license_scan": op9_license_scan, "op10_quality_rules": op10_quality_rules, "op11_fill_in_middle": op11_fill_in_middle, "op12_merkle_manifest": op12_merkle_manifest, "op13_bpe": op13_bpe}
ORACLES = {"op2_decontamination": OP2_SQL, "op3_line_dedup": OP3_SQL, "op10_quality_rules": OP10_SQL, "op11_fill_in_middle": OP11_SQL, "op12_merkle_manifest": _op12_sql()}
