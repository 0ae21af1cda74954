"""License scan by canonical digests (native).

A text is normalised (case, punctuation, copyright lines, equivalent
spellings, white space), hashed with SHA-256 and looked up by a hash join in
a table of known digests, which is made by the same normalisation from the
known texts.  These are the notices of ``KNOWN`` and the whole licenses in
``license_texts``, read on the driver.  Whole documents and, since documents
quote notices, each of their lines are looked up as entire texts.  A document
may hold a license of several paragraphs, wrapped in any way, among other text:
a known text is found as well where its paragraphs stand one after the other.
The known table is a parameter of bounded size (``MAX_KNOWN`` texts), so it may
be broadcast.

A line that begins with "copyright" or "(c)" may also be the wrapped middle of
a sentence or an item of a list.  ``normalised`` drops it nevertheless, so
whole texts and paragraphs are looked up in a second form as well, which drops
copyright notices only and does not depend on how a text is wrapped.

Defined results: a paragraph ends at a line without letters and digits, and
paragraphs that normalise to nothing do not count; a null text is an empty one and has no license; a text of
copyright lines alone normalises to nothing and has none; rows that share a
doc_id get a row each, with the licenses of all of them.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import store
from quarry.llm.quality import let

MAX_KNOWN = 10_000

# License ids and the notices and texts that stand for them.
KNOWN = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the \"License\");"],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
            "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
            "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
            "following conditions: The above copyright notice and this permission notice shall be included in all "
            "copies or substantial portions of the Software."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.",
                "Licensed under the GNU General Public License, version 3."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
}

TEXTS = Path(__file__).with_name("license_texts")  # <license id>[.variant].txt

# Lines that stand above a whole license, besides copyright lines.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "Expat License"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "Simplified BSD License", "BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "New BSD License", "Modified BSD License", "BSD License"],
}
RESERVED = "All rights reserved."

# Equivalent spellings, applied in this order to lower-case text.
SPELLINGS = [("licence", "license"), ("sub-license", "sublicense"), ("non-commercial", "noncommercial"),
             ("merchantibility", "merchantability"), ("per cent", "percent"), ("copyright owner", "copyright holder"),
             ("https://", "http://"), ("&", " and ")]

# A notice, on lower-case text: with a year, a sign or a placeholder, or a paragraph of one line.
NOTICE = (r"(?m)^[^a-z0-9\n]*(?:(?:copyright|\(c\)|©)[^a-z0-9\n]*(?:c\)[^a-z0-9\n]*)?(?:\d{4}|year|yyyy)|copyright[^a-z0-9\n]*(?:\(c\)|©))[^\n]*$"
          r"|(?<=\A|\n\n)[ \t]*copyright[^\n]*(?=\n\n|\n?\z)")
PARAGRAPH_END = r"\n[^\p{L}\p{N}\n]*(?=\n)"
COPYRIGHT_LINE = r"(?m)^[^a-z0-9\n]*(copyright|\(c\)|©)[^\n]*$"


def normalised(text: Column) -> Column:
    return _plain(F.regexp_replace(F.lower(text), COPYRIGHT_LINE, " "))


def _plain(out: Column) -> Column:
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))


def digest(text: Column) -> Column:
    return let(normalised(text), lambda clean: F.when(clean != "", F.sha2(clean, 256)))


def paragraphs(text: Column) -> Column:
    """Paragraphs in the second form, without those that are empty in it."""
    lines = F.regexp_replace(F.regexp_replace(F.lower(text), r"\r\n?", "\n"), NOTICE, " ")
    return F.filter(F.transform(F.split(lines, PARAGRAPH_END, -1), _plain), lambda p: p != "")


def digests(parts: Column) -> Column:
    return F.transform(parts, lambda p: F.sha2(p, 256))


def joined_digest(parts: Column) -> Column:
    return F.sha2(F.array_join(parts, " "), 256)


def whole_texts() -> dict[str, list[str]]:
    """The licenses of ``license_texts`` as they are usually given: with and
    without a title, what follows the terms, or the numbers of a short list,
    and with its items as paragraphs or not."""
    out: dict[str, list[str]] = {}
    for path in sorted(TEXTS.glob("*.txt")):
        name = path.name.removesuffix(".txt").removesuffix(".regents")
        text = path.read_text("utf-8")
        forms = [text]
        if "END OF TERMS AND CONDITIONS" in text:
            terms, _ = text.split("END OF TERMS AND CONDITIONS", 1)
            forms += [terms, terms + "END OF TERMS AND CONDITIONS"]
        if name.startswith("BSD"):
            body = text[text.index("Redistribution"):]
            close = re.sub(r"\n+(\d\. )", r"\n\1", body)
            apart = re.sub(r"\n+(\d\. )", r"\n\n\1", body)
            forms = [re.sub(r"(?m)^\d\. ", mark, form) for form in (close, apart, apart.replace("\n\n1. ", "\n1. ")) for mark in (r"\g<0>", "* ")]
        heads = ["", *TITLES.get(name, [])]
        heads += [f"{head}\n\n{RESERVED}".strip() for head in heads] if name in TITLES else []
        out.setdefault(name, []).extend(f"{head}\n\n{form}" for head in heads for form in forms)
    return out


def known_table(spark: SparkSession, known: dict | None = None) -> DataFrame:
    """license_id and digest of every known text; digests of its paragraphs
    and of these joined."""
    if known is None:
        known = {k: [*KNOWN.get(k, []), *whole.get(k, [])] for whole in [whole_texts()] for k in {**KNOWN, **whole}}
    rows = [(k, t) for k, texts in known.items() for t in texts]
    if len(rows) > MAX_KNOWN:
        raise ValueError(f"more than {MAX_KNOWN} known texts")
    parts = paragraphs(F.col("text"))
    return (spark.createDataFrame(rows, "license_id string, text string")
            .select("license_id", digest(F.col("text")).alias("digest"), digests(parts).alias("paragraphs"), joined_digest(parts).alias("joined"))
            .distinct())


def _items(text: Column) -> Column:
    """One row-local expression: the digests of the whole text, with that of
    its joined paragraphs, of its lines and of its paragraphs."""
    def item(kind: str, at: Column, value: Column, joined: Column = F.lit(None).cast("string")) -> Column:
        return F.struct(F.lit(kind).alias("kind"), at.cast("int").alias("at"), value.alias("digest"), joined.alias("joined"))

    # no rule of the first form reaches over a line's end, so the lines give the text
    lines = F.filter(F.transform(F.split(text, "\n", -1), normalised), lambda line: line != "")
    return let(F.struct(lines.alias("lines"), paragraphs(text).alias("parts")), lambda x: F.concat(
        F.array(item("text", F.lit(0), F.when(F.size(x["lines"]) > 0, joined_digest(x["lines"])), joined_digest(x["parts"]))),
        F.transform(x["lines"], lambda line: item("line", F.lit(0), F.sha2(line, 256))),
        F.transform(x["parts"], lambda part, at: item("paragraph", at, F.sha2(part, 256)))))


def _looked_up(docs: DataFrame, known: DataFrame) -> DataFrame:
    """The one pass over the texts: rows of a text with its digests, and of
    the lines and paragraphs that a known text has, stored."""
    marks = (known.select(F.lit("line").alias("kind"), "digest")
             .union(known.select(F.lit("paragraph"), F.explode("paragraphs"))).distinct())
    items = (docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("t"), F.monotonically_increasing_id().alias("row"))  # rows may share a doc_id
             .select("doc_id", "row", F.inline(_items(F.col("t")))))
    hits = items.join(F.broadcast(marks.withColumn("known", F.lit(True))), ["kind", "digest"], "left")
    return store(hits.where("known OR kind = 'text'").drop("known"), "licenses")


def _quoted(parts: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id and license_id of known texts whose paragraphs stand one after
    the other in a document."""
    known = known.select("license_id", F.xxhash64("license_id", "paragraphs").alias("known_id"), F.size("paragraphs").alias("n"),
                         F.posexplode("paragraphs").alias("k", "digest"))
    return (parts.join(F.broadcast(known), "digest")
            .groupBy("doc_id", "row", "license_id", "known_id", "n", (F.col("at") - F.col("k")).alias("start"))
            .count().where("count = n").select("doc_id", "license_id"))


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, text_digest, whole_license, licenses (sorted, comma-joined) and
    n_notices (lines that are a known text), one row per document.

    The texts are read and normalised once; all joins read the stored digests."""
    items = _looked_up(docs, known)
    texts = known.select("license_id", "digest").distinct()
    found = (items.where("kind = 'line'").join(F.broadcast(texts), "digest")
             .select("doc_id", "license_id", F.lit(1).alias("notice"))
             .union(_quoted(items.where("kind = 'paragraph'"), known).withColumn("notice", F.lit(0))).groupBy("doc_id")
             .agg(F.sum("notice").alias("n_notices"), F.collect_set("license_id").alias("ids")))
    whole = F.broadcast(texts.select(F.col("digest").alias("text_digest"), F.col("license_id").alias("by_text")))
    joined = F.broadcast(known.select("joined", F.col("license_id").alias("by_joined")).distinct())
    out = (items.where("kind = 'text'").select("doc_id", F.col("digest").alias("text_digest"), "joined")
           .join(whole, "text_digest", "left").join(joined, "joined", "left")
           .select("doc_id", "text_digest", F.coalesce("by_text", "by_joined").alias("whole_license")).alias("a")
           .join(found.withColumnRenamed("doc_id", "f_id").alias("f"), F.col("a.doc_id").eqNullSafe(F.col("f_id")), "left"))
    ids = F.sort_array(F.array_union(F.coalesce("ids", F.array().cast("array<string>")),
                                     F.when(F.col("whole_license").isNotNull(), F.array("whole_license"))
                                     .otherwise(F.array().cast("array<string>"))))
    return out.select("a.doc_id", "text_digest", "whole_license", F.array_join(ids, ",").alias("licenses"),
                      F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"))


def _sql_norm(x: str) -> str:
    out = f"regexp_replace(lower({x}), '{COPYRIGHT_LINE}', ' ', 'g')"
    for old, new in SPELLINGS:
        out = f"replace({out}, '{old}', '{new}')"
    return f"trim(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def _values() -> str:
    return ", ".join("('%s', '%s')" % (k, t.replace("'", "''")) for k, ts in KNOWN.items() for t in ts)


OP9_SQL = f"""
WITH k AS (SELECT DISTINCT l AS license_id, {_sql_norm('t')} AS n FROM (VALUES {_values()}) v(l, t)),
d AS (SELECT doc_id, coalesce(text, '') AS t, {_sql_norm("coalesce(text, '')")} AS n FROM documents),
x AS (SELECT doc_id, {_sql_norm('line')} AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)),
f AS (SELECT doc_id, license_id FROM x JOIN k ON x.n = k.n WHERE x.n <> ''),
a AS (SELECT doc_id, license_id FROM f UNION SELECT doc_id, license_id FROM d JOIN k ON d.n = k.n WHERE d.n <> '')
SELECT d.doc_id, CASE WHEN d.n <> '' THEN sha256(d.n) END AS text_digest, k.license_id AS whole_license,
  coalesce((SELECT string_agg(license_id, ',' ORDER BY license_id) FROM a WHERE a.doc_id = d.doc_id), '') AS licenses,
  (SELECT count(*) FROM f WHERE f.doc_id = d.doc_id) AS n_notices
FROM d LEFT JOIN k ON d.n = k.n AND d.n <> ''
"""
