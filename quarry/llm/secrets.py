"""Secret scan: fixed patterns and character Markov models (native).

The patterns find assignments, access keys and long hex strings.  Two
first-order Markov models over characters, one of random strings and one of
ordinary identifiers, are trained from labelled samples by counting character
pairs; a long token that no pattern covers is a secret when its
log-likelihood ratio exceeds a margin.

Training is bounded: ``TRAIN_RANDOM`` hashes of a running number in six
alphabets as random strings, and as ordinary identifiers the words of about
``TRAIN_DOCUMENTS`` documents (those whose id has a hash below that share of
its range) and of Spark's settings.
The model is a table of 80 x 80 scores.  Scanning covers every whole text.

Defined results: a null text is an empty one without spans; equal rows get
equal rows; other columns are ignored, whatever their names.  Positions count
code points from 0, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.quality import let

# The patterns of the three kinds, in listed order.
ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")

#: Tokens that the Markov models judge, and the margin in nats for a secret.
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
MARGIN = 10.0

TRAIN_RANDOM = 4096
TRAIN_DOCUMENTS = 2000
LOW, WIDTH = 43, 80  # characters '+' to 'z'
CHUNK = 512


def _totals(lengths: Column) -> Column:
    """Sums before each element, in chunks: a row's work stays near linear."""

    def within(part):
        return F.aggregate(part, F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("a")),
                           lambda s, x: F.struct((s["n"] + x).alias("n"), F.array_append(s["a"], s["n"]).alias("a")))

    def joined(parts):
        bases = F.aggregate(F.transform(parts, lambda p: p["n"]),
                            F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("a")),
                            lambda s, x: F.struct((s["n"] + x).alias("n"), F.array_append(s["a"], s["n"]).alias("a")))["a"]
        return F.flatten(F.zip_with(parts, bases, lambda p, b: F.transform(p["a"], lambda x: x + b)))

    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / CHUNK).cast("int")),
                        lambda k: within(F.slice(lengths, k * CHUNK + 1, CHUNK)))
    return F.when(F.size(lengths) == 0, F.array().cast("array<int>")).otherwise(let(parts, joined))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Leftmost non-overlapping matches: array of (s, e, v), v being ``group``.

    What lies between matches has a length and so has each match; their
    running sums are the positions."""
    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: let(
        F.split(text, pattern, -1), lambda gaps: let(
            F.transform(m, lambda x, i: F.length(F.get(gaps, i)) + F.length(x)), lambda steps: let(
                _totals(steps), lambda before: F.transform(m, lambda x, i: F.struct(
                    (F.get(before, i) + F.length(F.get(gaps, i))).cast("long").alias("s"),
                    (F.get(before, i) + F.get(steps, i)).cast("long").alias("e"), x.alias("m")))))))
    empty = F.array().cast("array<struct<s:bigint,e:bigint,m:string>>")
    if group:
        empty = F.array().cast("array<struct<s:bigint,e:bigint,m:string,v:string>>")
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        found = F.zip_with(found, values, lambda a, v: F.struct(a["s"].alias("s"), a["e"].alias("e"), a["m"].alias("m"), v.alias("v")))
    return F.when(text.rlike(pattern), found).otherwise(empty)


def _forms(w: Column) -> Column:
    """Ordinary tokens made of the words of a text: alone, joined in the ways
    of identifiers and paths, with digits, in upper case; numbers and ruled
    lines in their places."""
    def form(x, i):
        few = lambda n: F.slice(w, i + 1, n)
        digits = F.abs(F.xxhash64(x)).cast("string")
        day = F.concat_ws("-", F.concat(F.lit("20"), F.substring(digits, 1, 2)), F.lpad((i % 12 + 1).cast("string"), 2, "0"),
                          F.lpad((i % 28 + 1).cast("string"), 2, "0"))
        made = [F.concat_ws("_", few(3)), F.concat_ws("-", few(2)), F.concat(x, (i % 100).cast("string")), F.concat_ws("/", few(3)),
                F.concat_ws("", F.transform(few(3), F.initcap)), F.upper(F.concat_ws("_", few(3))), F.concat_ws("-", day, x),
                F.concat_ws("_", F.concat_ws("_", few(2)), F.substring(digits, 1, 4)),
                F.concat_ws("/", x, F.concat(F.lit("v"), (i % 10).cast("string")), F.concat_ws("", F.transform(few(2), F.initcap))),
                F.substring(digits, 1, 16), F.repeat(F.get(F.array(*[F.lit(c) for c in "-=_+/"]), F.floor(i / 14).cast("int") % 5), 16)]
        out = x
        for k, value in enumerate(made):
            out = F.when(i % 14 == k, value).otherwise(out)
        return out

    return F.transform(w, form)


def samples(docs: DataFrame) -> DataFrame:
    """Labelled strings (token, random): hashes in several alphabets; and as
    ordinary ones the words of a bounded number of documents, outside what the
    fixed patterns find, those of Spark's own settings and their descriptions
    (some 2,000 lines, for a corpus in other languages)."""
    spark = docs.sparkSession
    digest = F.sha2(F.col("id").cast("string").cast("binary"), 256)
    b64 = F.base64(F.unhex(digest))
    noise = spark.range(TRAIN_RANDOM).select(F.explode(F.array(
        F.substring(b64, 1, 40), F.translate(b64, "+/", "-_"), F.substring(digest, 1, 40), F.upper(F.substring(digest, 1, 40)),
        F.substring(F.regexp_replace(b64, "[+/=]", ""), 1, 30), F.substring(F.upper(F.regexp_replace(b64, "[+/=]", "")), 1, 30),
    )).alias("token"), F.lit(True).alias("random"))
    share = min(1.0, TRAIN_DOCUMENTS / max(1, docs.count()))
    few = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))).where("text IS NOT NULL") \
        .select(F.regexp_replace("text", f"{ASSIGN}|{ACCESS}|{HEX}", " ").alias("text"))
    settings = spark.sql("SET -v").select(F.concat_ws(" ", "key", "meaning").alias("text"))
    words = F.regexp_extract_all("text", F.lit(r"(?<![A-Za-z0-9])[A-Za-z]{2,}(?![A-Za-z0-9])"), F.lit(0))
    plain = few.unionByName(settings).select(words.alias("w")).where(F.size("w") > 0) \
        .select(F.explode(_forms(F.col("w"))).alias("token"), F.lit(False).alias("random"))
    return noise.unionByName(plain)


def train(labelled: DataFrame) -> list[float]:
    """Log-likelihood ratios of the 80 x 80 character pairs, with one count
    added to each.  The driver receives these sums only (12,800 at most)."""
    chars = F.split("token", "")
    pairs = F.when(F.length("token") > 1, F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda i: F.struct(
        (F.ascii(F.get(chars, i - 1)) - LOW).alias("a"), (F.ascii(F.get(chars, i)) - LOW).alias("b"))))
    counted = (labelled.select("random", F.explode(pairs).alias("p")).where("p.a BETWEEN 0 AND 79 AND p.b BETWEEN 0 AND 79")
               .groupBy("random", "p.a", "p.b").agg(F.count(F.lit(1)).alias("n")).collect())
    import math
    n = {(r["random"], r["a"], r["b"]): r["n"] for r in counted}
    of = {}
    for (kind, a, _), c in n.items():
        of[kind, a] = of.get((kind, a), 0) + c
    score = lambda kind, a, b: math.log((n.get((kind, a, b), 0) + 1) / (of.get((kind, a), 0) + WIDTH))
    return [round(score(True, a, b) - score(False, a, b), 4) for a in range(WIDTH) for b in range(WIDTH)]


def ratio(token: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of a token, random against ordinary."""
    scores = F.split(F.lit(",".join(map(str, model))), ",").cast("array<double>")
    return let(F.transform(F.split(token, ""), lambda c: F.ascii(c) - LOW), lambda c: F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.size(c) - 1, F.lit(1))), F.lit(0.0),
        lambda s, i: s + F.coalesce(F.get(scores, F.get(c, i - 1) * WIDTH + F.get(c, i)), F.lit(0.0))))


def spans(docs: DataFrame, model: list[float], column: str = "__spans") -> DataFrame:
    """The columns of ``docs`` and ``column``: array of (s, k, e), sorted; k
    indexes KINDS."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def kind(found, k):
        return F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e")))

    assign = F.filter(matches(text, ASSIGN, 1), lambda x: F.length(x["v"]) >= 6)
    base = F.concat(kind(assign, 0), kind(matches(text, ACCESS), 1), kind(matches(text, HEX), 2))

    def with_markov(fixed):
        odd = F.filter(matches(text, TOKEN), lambda x: (ratio(x["m"], model) > MARGIN)
                       & ~F.exists(fixed, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
        return F.sort_array(F.concat(fixed, kind(odd, 3)))

    return docs.select("*", let(base, with_markov).alias(column))


def _written(found: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(
        ":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def scan(docs: DataFrame, model: list[float]) -> DataFrame:
    """doc_id, counts per kind, digest of the fixed spans and all spans."""
    found = spans(docs.select("doc_id", "text"), model)
    n = lambda k: F.size(F.filter("__spans", lambda x: x["k"] == k)).cast("long")
    return found.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), n(3).alias("n_markov"),
        F.sha2(_written(F.filter("__spans", lambda x: x["k"] < 3)), 256).alias("base_sha256"), _written(F.col("__spans")).alias("spans"))


def redact(docs: DataFrame, model: list[float], mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span in ``text`` replaced by ``mark``; overlapping
    spans become one mark.  Texts without spans are left alone; ``n_chars``,
    if there is one, follows the text."""
    column = "__spans"
    while column in [c.lower() for c in docs.columns]:
        column += "_"
    found, own = spans(docs, model, column), F.col(column)

    def rebuilt(s):
        end = F.lit(0).cast("long")
        state = F.struct(end.alias("end"), F.array().cast("array<string>").alias("out"))

        def step(a, x):
            gap = F.expr("substring(text, 1, 0)")
            piece = F.when(x["s"] >= a["end"], F.concat(
                F.col("text").substr((a["end"] + 1).cast("int"), (x["s"] - a["end"]).cast("int")), F.lit(mark))).otherwise(gap)
            return F.struct(F.greatest(a["end"], x["e"]).alias("end"), F.array_append(a["out"], piece).alias("out"))

        return let(F.aggregate(s, state, step), lambda a: F.concat(
            F.array_join(a["out"], ""), F.col("text").substr((a["end"] + 1).cast("int"), F.length("text"))))

    clean = F.when(F.size(own) > 0, rebuilt(own)).otherwise(F.col("text"))
    out = found.withColumn("text", clean)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(own) > 0, F.length("text").cast(docs.schema["n_chars"].dataType))
                             .otherwise(F.col("n_chars")))
    return out.select(*[f"`{c}`" for c in docs.columns])


def fitted(spark: SparkSession, docs: DataFrame) -> list[float]:
    return train(samples(docs))
