"""License scan: ordered signature rules behind a keyword prefilter, overlaps resolved by rank and containment.

A text is reduced to its words joined by single blanks, and every rule is a regular expression over
that line. A rule runs only if the text holds its keyword, and no rule runs on a text without any
keyword. Matches become intervals of word numbers; an interval inside one of a rule ranked the same
or better is dropped. Everything is one projection of a row: no join, no shuffle, no user function.

Defined results: null and empty texts have no words and no findings; overlapping matches of one rule
are taken leftmost first; repeated rows give equal rows; other columns are passed on untouched.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import fresh, let, plain_words

# Phrases whose places are counted, with their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# Rank of a rule, best first, and the confidence of a finding by it.
TAG, GRANT, TITLE, SHORT, PHRASE = 1, 2, 3, 4, 5
CONFIDENCE = {TAG: 1.0, GRANT: 0.95, TITLE: 0.8, SHORT: 0.5, PHRASE: 0.5}

_V = r"(?: license)?(?: version)?(?: v)? ?"


@dataclass(frozen=True)
class License:
    """``tag`` and ``name`` are regular expressions over blank-joined words; ``short`` is a usual short form."""

    label: str
    keyword: str
    tag: str
    name: str
    short: str | None = None
    url: str | None = None


def _versions(label: str, keyword: str, name: str, short: str | None, versions: str, url: str | None = None):
    """A family: the name without a version, and each version of it."""
    yield License(label, keyword, label.replace("-", " "), name, short, url)
    for version in versions.split():
        number = version.replace(".", " ").removesuffix(" 0") + ("(?: 0)?" if version.endswith(".0") else "")
        yield License(
            f"{label}-{version}", keyword, f"{label.replace('-', ' ')} {version.replace('.', ' ')}",
            f"{name}{_V}v?{number}", f"{short} ?v?{number}" if short else None, f"{url} {number}" if url else None,
        )


def _creative_commons():
    """The six licenses and the public domain tool, each with its versions."""
    names = {
        "cc-by": "attribution", "cc-by-sa": "attribution share ?alike", "cc-by-nd": "attribution no ?derivatives",
        "cc-by-nc": "attribution non ?commercial", "cc-by-nc-sa": "attribution non ?commercial share ?alike",
        "cc-by-nc-nd": "attribution non ?commercial no ?derivatives",
    }
    for label, name in names.items():
        yield from _versions(
            label, "creative commons", f"creative commons {name}",
            label.replace("-", " "), "1.0 2.0 2.5 3.0 4.0",
            f"creativecommons org licenses {label.removeprefix('cc-').replace('-', ' ')}",
        )
    yield License("cc0-1.0", "cc0", "cc0 1 0", "cc0(?: 1 0)?(?: universal)?", None, "creativecommons org publicdomain zero 1 0")


LICENSES = (
    *_versions("gpl", "general public", "gnu general public license", "gpl", "1.0 2.0 3.0", "gnu org licenses gpl"),
    *_versions("lgpl", "lesser general", "gnu lesser general public license", "lgpl", "2.0 2.1 3.0", "gnu org licenses lgpl"),
    *_versions("agpl", "affero general", "gnu affero general public license", "agpl", "1.0 3.0", "gnu org licenses agpl"),
    *_versions("gfdl", "documentation license", "gnu free documentation license", "gfdl", "1.1 1.2 1.3", "gnu org licenses fdl"),
    *_versions("apache", "apache", "apache(?: software)? license", None, "1.0 1.1 2.0", "apache org licenses license"),
    *_versions("mpl", "mozilla public", "mozilla public license", "mpl", "1.0 1.1 2.0", "mozilla org mpl"),
    *_versions("epl", "eclipse public", "eclipse public license", "epl", "1.0 2.0", "eclipse org legal epl"),
    *_versions("eupl", "european union", "european union public licen[cs]e", "eupl", "1.0 1.1 1.2", None),
    *_versions("cddl", "distribution license", "common development and distribution license", "cddl", "1.0 1.1", None),
    *_versions("osl", "open software", "open software license", "osl", "1.0 2.0 2.1 3.0", None),
    *_versions("afl", "academic free", "academic free license", "afl", "1.1 2.0 2.1 3.0", None),
    *_versions("artistic", "artistic license", "artistic license", None, "1.0 2.0", "opensource org licenses artistic license"),
    *_versions("bsl", "boost software", "boost software license", None, "1.0", "boost org license"),
    *_versions("busl", "business source", "business source license", None, "1.1", None),
    *_versions("cecill", "cecill", "cecill free software license(?: agreement)?", "cecill", "1.0 2.0 2.1", None),
    *_versions("lppl", "latex project", "latex project public license", "lppl", "1.0 1.2 1.3", None),
    *_versions("ofl", "font license", "sil open font license", None, "1.0 1.1", "scripts sil org ofl"),
    *_versions("odbl", "database license", "open (?:data commons open )?database license", "odbl", "1.0", None),
    *_versions("python", "python software", "python software foundation license", "psf license", "2.0", None),
    *_versions("php", "php license", "php license", None, "3.0 3.01", "php net license"),
    *_versions("zpl", "zope public", "zope public license", "zpl", "1.1 2.0 2.1", None),
    *_versions("upl", "universal permissive", "universal permissive license", None, "1.0", None),
    *_creative_commons(),
    License("mit", "mit license", "mit", "(?:the )?mit license", "mit licensed", "opensource org licenses mit"),
    License("bsd", "bsd", "bsd", "(?:the )?bsd license", "bsd licensed", None),
    License("bsd-2-clause", "bsd", "bsd 2 clause", "(?:simplified bsd|bsd 2 clause|2 clause bsd)(?: license)?", None, "opensource org licenses bsd 2 clause"),
    License("bsd-3-clause", "bsd", "bsd 3 clause", "(?:(?:new|modified|revised) bsd|bsd 3 clause|3 clause bsd)(?: license)?", None, "opensource org licenses bsd 3 clause"),
    License("bsd-4-clause", "bsd", "bsd 4 clause", "(?:original bsd|bsd 4 clause|4 clause bsd)(?: license)?", None, None),
    License("isc", "isc license", "isc", "isc license", None, "opensource org licenses isc"),
    License("zlib", "zlib", "zlib", "zlib(?: libpng)? license", None, "opensource org licenses zlib"),
    License("unlicense", "unlicense", "unlicense", "the unlicense", None, "unlicense org"),
    License("wtfpl", "do what", "wtfpl", "do what the fuck you want to public license", "wtfpl", None),
    License("ncsa", "ncsa open", "ncsa", "(?:university of illinois )?ncsa open source license", None, None),
    License("postgresql", "postgresql licen", "postgresql", "postgresql licen[cs]e", None, None),
    License("public-domain", "public domain", "public domain", "(?:dedicated to|released into|placed in(?:to)?) the public domain", None, None),
    License("proprietary", "rights reserved", "proprietary", "all rights reserved", None, None),
)

_FULL_TEXT = (
    # Opening or telling lines of license texts: label, keyword, expression.
    ("mit", "hereby", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "without warranty", "the software is provided as is without warranty of any kind express or implied"),
    ("isc", "hereby", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("gpl", "redistribute", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "redistribute", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("apache-2.0", "compliance", "you may not use this (?:file|work) except in compliance with the license"),
    ("mpl-2.0", "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("zlib", "arising", "in no event will the authors be held liable for any damages arising from the use of this software"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
)


def _rules() -> list[tuple[int, str, str, str]]:
    """(rank, keyword, expression, label): every license gives its rules by the same rule of formation."""
    grant = r"(?:licen[cs]ed|released|distributed|published|available)(?: \w+){0,3}? under(?: the)?(?: terms of)?(?: the)?"
    out = []
    for x in LICENSES:
        out.append((TAG, "spdx license", f"spdx license identifier {x.tag}", x.label))
        out.append((GRANT, x.keyword, f"{grant} {x.name}", x.label))
        out.append((TITLE, x.keyword, x.name, x.label))
        if x.url:
            out.append((GRANT, " ".join(x.url.split()[:2]), f"(?:https? )?(?:www )?{x.url}", x.label))
        if x.short:
            keyword = re.match(r"[a-z ]*[a-z]", x.short)[0]
            out.append((SHORT, keyword, x.short, x.label))
            out.append((GRANT, keyword, f"{grant} {x.short}", x.label))
    out += [(GRANT, keyword, text, label) for label, keyword, text in _FULL_TEXT]
    out += [(PHRASE, phrase, phrase, label) for phrase, label in PHRASES]
    return sorted(set(out))


RULES = tuple(_rules())
# A rule's keyword is in every match of it, at the beginning of a word; a text without any is passed over.
KEYWORDS = tuple(sorted({keyword for _, keyword, _, _ in RULES}))


def _gate() -> str:
    """One expression for "some word begins with a keyword", branching on the first letter."""
    by_letter: dict[str, list[str]] = {}
    for keyword in KEYWORDS:
        by_letter.setdefault(keyword[0], []).append(keyword[1:])
    return " (?:" + "|".join(f"{a}(?:{'|'.join(rest)})" for a, rest in by_letter.items()) + ")"


def _spaces(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def _places(line: Column, pattern: Column) -> Column:
    """Word intervals (first word, end exclusive) of a pattern's matches, leftmost first."""
    bounded = F.concat(F.lit("(?<= )(?:"), pattern, F.lit(")(?= )"))
    gaps, found = F.split(line, bounded), F.regexp_extract_all(line, bounded, F.lit(0))
    empty = F.array().cast("array<struct<s:int,e:int>>")
    return let(
        F.struct(gaps.alias("g"), found.alias("f")),
        lambda m: F.aggregate(
            F.arrays_zip(m["g"].alias("g"), m["f"].alias("f")),
            F.struct(empty.alias("spans"), F.lit(0).alias("at")),
            lambda acc, x: F.when(x["f"].isNull(), acc).otherwise(
                let(
                    acc["at"] + _spaces(x["g"]) - 1,
                    lambda s: F.struct(
                        F.concat(
                            acc["spans"], F.array(F.struct(s.alias("s"), (s + _spaces(x["f"]) + 1).alias("e")))
                        ).alias("spans"),
                        (s + _spaces(x["f"]) + 1).alias("at"),
                    ),
                )
            ),
            lambda acc: acc["spans"],
        ),
    )


def _kept(found: Column) -> Column:
    """Drops intervals inside one ranked the same or better; of equal intervals the best rule stays."""
    ranks = sorted(CONFIDENCE)
    empty = F.array().cast("array<struct<s:int,e:int,rank:int,label:string>>")
    in_order = F.array_sort(
        F.transform(
            found,
            lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("o"), x["rank"].alias("rank"), x["label"].alias("label")),
        )
    )

    def step(acc: Column, x: Column) -> Column:
        inside = F.greatest(*[F.when(F.lit(r) <= x["rank"], acc[f"m{r}"]).otherwise(-1) for r in ranks]) >= -x["o"]
        one = F.struct(x["s"].alias("s"), (-x["o"]).alias("e"), x["rank"].alias("rank"), x["label"].alias("label"))
        return F.struct(
            F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], F.array(one))).alias("out"),
            *[F.when(x["rank"] == r, F.greatest(acc[f"m{r}"], -x["o"])).otherwise(acc[f"m{r}"]).alias(f"m{r}") for r in ranks],
        )

    start = F.struct(empty.alias("out"), *[F.lit(-1).alias(f"m{r}") for r in ranks])
    return F.aggregate(in_order, start, step, lambda acc: acc["out"])


def _rule_table() -> Column:
    """The rules by keyword, as one constant."""
    by_keyword: dict[str, list[Column]] = {}
    for rank, keyword, pattern, label in RULES:
        rule = F.struct(F.lit(rank).alias("rank"), F.lit(pattern).alias("pattern"), F.lit(label).alias("label"))
        by_keyword.setdefault(keyword, []).append(rule)
    return F.array(*[F.struct(F.lit(" " + k).alias("keyword"), F.array(*v).alias("rules")) for k, v in by_keyword.items()])


def scanned(docs: DataFrame, text_col: str = "text", out: str = "license") -> DataFrame:
    """``docs`` and one struct more.

    ``n_words``; ``places`` (all intervals of the base phrases, with labels); ``findings`` (s, e, rank,
    label of what remains after suppression); ``labels``; ``score`` (confidence of the best finding).
    """
    words, line, gate = (fresh(docs, f"_license_{x}") for x in ("words", "line", "gate"))
    out = fresh(docs, out)
    none = F.array().cast("array<struct<s:int,e:int,rank:int,label:string>>")

    def run(rules: Column, line: Column) -> Column:
        hit = F.flatten(F.transform(F.filter(rules, lambda r: F.contains(line, r["keyword"])), lambda r: r["rules"]))
        return F.flatten(
            F.transform(
                hit,
                lambda r: F.transform(
                    _places(line, r["pattern"]),
                    lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), r["rank"].alias("rank"), r["label"].alias("label")),
                ),
            )
        )

    all_found = run(_rule_table(), F.col(line))
    result = fresh(docs, "_license_result")
    table = (
        docs.withColumn(words, plain_words(docs[text_col]))
        .withColumn(gate, F.size(words).cast("long"))
        .withColumn(line, F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")))
        .withColumn(
            result,
            F.when(F.col(line).rlike(_gate()), let(all_found, lambda f: F.struct(
                F.filter(f, lambda x: x["rank"] == PHRASE).alias("places"), _kept(f).alias("findings"))))
            .otherwise(F.struct(none.alias("places"), none.alias("findings"))),
        )
    )
    findings = F.col(result)["findings"]
    confidence = F.create_map(*[F.lit(v) for pair in CONFIDENCE.items() for v in pair])
    return table.withColumn(
        out,
        F.struct(
            F.col(gate).alias("n_words"),
            F.col(result)["places"].alias("places"),
            findings.alias("findings"),
            F.array_sort(F.array_distinct(F.transform(F.concat(findings, F.col(result)["places"]), lambda x: x["label"]))).alias("labels"),
            F.coalesce(F.array_max(F.transform(findings, lambda x: F.element_at(confidence, x["rank"]))), F.lit(0.0)).alias("score"),
        ),
    ).drop(words, gate, line, result)
