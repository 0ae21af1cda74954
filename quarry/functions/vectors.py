"""Column expressions for vectors: feature hashing, cosine, text form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def token_bucket(tok, dims: int) -> Column:
    """md5 feature hash of one token: first 8 hex digits as a number, mod dims."""
    return F.pmod(F.conv(F.substring(F.md5(tok), 1, 8), 16, 10).cast("long"), F.lit(dims))


def l2_norm(v) -> Column:
    return F.sqrt(F.aggregate(_c(v), F.lit(0.0), lambda acc, x: acc + x * x))


def with_hash_embedding(df, token_col: str, dims: int = 64, out: str = "embedding"):
    """Offline embedder: md5 feature hashing to ``dims``, L2-normalised.

    Staged in three projections so that lambdas only see column references
    (Catalyst does not de-duplicate work inside lambda bodies).
    """
    keep = [c for c in df.columns if c not in (token_col, out)]
    buckets = df.select(*keep, F.transform(token_col, lambda t: token_bucket(t, dims)).alias("_bkt"))
    # "_bkt" is referenced twice on purpose: CollapseProject then keeps it a
    # column instead of inlining the md5 work into the per-dimension lambda.
    # Count per dimension with the native array_remove (no per-element lambda).
    counts = buckets.select(*keep, F.when(F.size("_bkt") >= 0, F.transform(
        F.sequence(F.lit(0).cast("long"), F.lit(dims - 1).cast("long")),
        lambda d: (F.size("_bkt") - F.size(F.array_remove("_bkt", d))).cast("double"))).alias("_cnt"))
    normed = counts.select(*keep, "_cnt", l2_norm("_cnt").alias("_nrm"))
    return normed.select(*keep, F.when(F.col("_nrm") > 0, F.transform("_cnt", lambda x: x / F.col("_nrm")))
                         .alias(out))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a).cast("array<double>"), _c(b).cast("array<double>"),
                                  lambda x, y: x * y),
                       F.lit(0.0), lambda acc, x: acc + x)


def cosine(a, b) -> Column:
    """dot / (|a|·|b|) in double; null when either norm is 0."""
    na, nb = l2_norm(_c(a).cast("array<double>")), l2_norm(_c(b).cast("array<double>"))
    return F.when((na > 0) & (nb > 0), dot(a, b) / (na * nb))


def parse_vector(text) -> Column:
    """'[a,b,...]' -> array<float>."""
    return F.from_json(_c(text), "array<float>")


def format_vector(v) -> Column:
    """array -> '[a,b,...]' text."""
    return F.concat(F.lit("["), F.array_join(F.transform(_c(v), lambda x: x.cast("string")), ","),
                    F.lit("]"))
