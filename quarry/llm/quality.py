"""Quality rules as a bitmask ledger (native).

Every rule is evaluated once for each document; the ledger keeps the
measurements and one bit per failed rule.  Policies are versioned masks over
these bits, so a policy change or an ablation reads the ledger and never the
texts again.

Defined results: a null text is an empty one (no words, ``short`` fails); any
null id is kept as it is; repeated rows get a ledger row each; other columns of
the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = r"[\x20\x09-\x0D]+"

#: Rule names in bit order: bit k is set when rule k fails.
RULES = ("short", "repeated_windows", "symbols", "duplicate_lines", "shouting", "stutter", "long_words")

#: Version of a policy -> the rules that it enforces.
POLICIES = {
    "base": ("short", "repeated_windows"),
    "v1": RULES,
}
CURRENT = "v1"


def let(value: Column, body) -> Column:
    """``body`` over a value that is computed once for the row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words covered by 8-word windows that occur twice or more.

    Windows are compared by 64-bit hashes within one text; sorting puts equal
    windows side by side, and a fold over their starts adds up the cover."""
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 8), lambda i: F.xxhash64(F.slice(words, i + 1, 8)))

    def cover(starts):
        return F.aggregate(
            starts, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
            lambda a, p: F.struct((a["n"] + 8 - F.greatest(F.lit(0).cast("long"), a["end"] - p)).alias("n"),
                                  (p + 8).cast("long").alias("end")))["n"]

    def repeated(s):
        same = F.filter(s, lambda e, i: F.coalesce(F.get(s, i - 1)["h"] == e["h"], F.lit(False))
                        | F.coalesce(F.get(s, i + 1)["h"] == e["h"], F.lit(False)))
        return cover(F.sort_array(F.transform(same, lambda e: e["i"])))

    def counted(h):
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.cast("long").alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(placed, repeated))

    return F.when(F.size(words) < 9, F.lit(0).cast("long")).otherwise(let(hashes, counted))


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and ``failed_bits``, one row per document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    kept_lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    measured = docs.select(
        F.col("doc_id"),
        let(F.array_remove(F.split(text, WHITE, -1), ""), lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            _repeat_words(w).alias("n_repeat_words"),
            F.when(F.size(w) < 2, F.lit(0)).otherwise(
                F.size(F.filter(w, lambda x, i: F.coalesce(F.get(w, i - 1) == x, F.lit(False)))))
            .cast("long").alias("n_stutter"))).alias("w"),
        let(kept_lines, lambda x: F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("l"),
        F.length(F.regexp_replace(text, WHITE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"))
    m = measured.select("doc_id", "w.*", "l.*", "word_chars", "n_symbols", "n_upper")
    failed = {
        "short": F.col("n_words") < 20,
        "repeated_windows": 100 * F.col("n_repeat_words") > 30 * F.col("n_words"),
        "symbols": 100 * F.col("n_symbols") > 30 * F.col("n_words"),
        "duplicate_lines": 100 * F.col("n_dup_lines") > 50 * F.col("n_lines"),
        "shouting": 100 * F.col("n_upper") > 50 * F.col("word_chars"),
        "stutter": 100 * F.col("n_stutter") > 30 * F.col("n_words"),
        "long_words": F.col("word_chars") > 20 * F.col("n_words"),
    }
    bits = F.lit(0).cast("long")
    for k, rule in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(failed[rule], F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")))
    return m.withColumn("failed_bits", bits)


def mask(policy: str) -> int:
    return sum(1 << RULES.index(rule) for rule in POLICIES[policy])


def rejected(policy: str) -> Column:
    return F.col("failed_bits").bitwiseAND(F.lit(mask(policy)).cast("long")) != 0


def apply_policy(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The ledger with ``base_failed`` and the verdict ``kept`` of one policy."""
    return rows.withColumns({"base_failed": rejected("base"), "kept": ~(rejected("base") | rejected(policy))})


def ablations(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """For each rule of a policy: documents failing it, and documents that
    would come back without it.  One pass counts the bit patterns (at most
    2**len(RULES) of them); the rest is arithmetic on these counts."""
    on = F.lit(mask(policy)).cast("long")
    patterns = rows.groupBy(F.col("failed_bits").bitwiseAND(on).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES.index(r)).cast("long").alias("bit"))
                                for r in POLICIES[policy]])).alias("r")
    return (patterns.select("bits", "n", rules).groupBy(F.col("r.rule").alias("rule"))
            .agg(F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
                 F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"),
                 F.sum("n").alias("n_documents")))


def keep_good(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The rows of ``docs`` that a policy keeps, columns as they are.

    The verdict is a boolean over the row's own text, so it is joined to
    nothing: the text is measured in the same pass that passes it on."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    carried = docs.select(F.col("text"), row.alias("doc_id"))  # the whole row rides in the id's place
    return apply_policy(ledger(carried), policy).where("kept").select("doc_id.*")


OP1_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t,
        list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 7), ' ') AS g
        FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 7)) AS i FROM w WHERE len(w) >= 9)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + 7)) AS p FROM rep) GROUP BY 1),
m AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
        len(list_filter(generate_series(2, len(w)), lambda i: w[i] = w[i - 1]))::BIGINT AS n_stutter,
        len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
        length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
        length(regexp_replace(t, '[^\p{Lu}]+', '', 'g'))::BIGINT AS n_upper
      FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id),
b AS (SELECT *, ((n_words < 20)::INT + 2 * (100 * n_repeat_words > 30 * n_words)::INT + 4 * (100 * n_symbols > 30 * n_words)::INT
        + 8 * (100 * n_dup_lines > 50 * n_lines)::INT + 16 * (100 * n_upper > 50 * word_chars)::INT
        + 32 * (100 * n_stutter > 30 * n_words)::INT + 64 * (word_chars > 20 * n_words)::INT)::BIGINT AS failed_bits FROM m)
SELECT doc_id, n_words, n_repeat_words, n_stutter, n_lines, n_dup_lines, word_chars, n_symbols, n_upper, failed_bits,
  (failed_bits & 3) <> 0 AS base_failed, failed_bits = 0 AS kept FROM b
"""
