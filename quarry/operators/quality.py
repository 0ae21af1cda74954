"""Validation and filter predicates (all native Column expressions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T

# ISO dates as Python's fromisoformat (plus the YYYY-MM-DD fallback) accepts
# them: a date and an optional time (hour, minute, second, fraction) after 'T'
# or ' ', each with all of its separators or with none, and an optional zone.
# Week dates are not supported.
ISO_DATE_RE = (r"^(\d{4})(-?)(\d{2})\2(\d{2})"
               r"(?:[T ](\d{2})(?:(:?)(\d{2})(?:\6(\d{2})(?:[.,]\d+)?)?)?"
               r"(?:Z|[+-]\d{2}(?::?\d{2})?)?)?$")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def valid_native_id(c) -> Column:
    """Non-null, non-blank after trim, shorter than 200 characters."""
    s = _c(c).cast("string")
    return F.coalesce(s.isNotNull() & (F.length(T.py_strip(s)) > 0) & (F.length(s) < 200),
                      F.lit(False))


def iso_date_ok(c) -> Column:
    """True when the text is a calendar-valid ISO date/time (see ISO_DATE_RE)."""
    s = F.regexp_replace(_c(c), "Z$", "+00:00")
    y = F.regexp_extract(s, ISO_DATE_RE, 1)
    m = F.regexp_extract(s, ISO_DATE_RE, 3)
    d = F.regexp_extract(s, ISO_DATE_RE, 4)
    hh = F.regexp_extract(s, ISO_DATE_RE, 5)
    mi = F.regexp_extract(s, ISO_DATE_RE, 7)
    ss = F.regexp_extract(s, ISO_DATE_RE, 8)
    date_ok = F.try_to_timestamp(F.concat_ws("-", y, m, d), F.lit("yyyy-MM-dd")).isNotNull()

    def in_range(part, hi):
        return (part == "") | (part.cast("int") < hi)
    iso = s.rlike(ISO_DATE_RE) & date_ok & in_range(hh, 24) & in_range(mi, 60) & in_range(ss, 60)
    # strptime('%Y-%m-%d') fallback: one- or two-digit month and day.
    raw = _c(c)
    short = raw.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$") & F.try_to_timestamp(raw, F.lit("yyyy-M-d")).isNotNull()
    return F.coalesce(iso | short, F.lit(False))


def validation_error(native_id, title, content, date_decision) -> Column:
    """Ordered rules; null when the document is valid, else the reason."""
    nid, ti, co, dd = _c(native_id), _c(title), _c(content), _c(date_decision)
    empty = lambda x: x.isNull() | (x == "")
    return (F.when(~valid_native_id(nid), F.concat(F.lit("Invalid NativeId: "),
                                                   F.coalesce(nid.cast("string"), F.lit("None"))))
            .when(empty(ti) & empty(co), F.concat(F.lit("Document "), nid.cast("string"),
                                                  F.lit(" has no Title or Content")))
            .when(~empty(dd) & ~iso_date_ok(dd), F.concat(F.lit("Invalid DateDecision format: "), dd)))


def validate_documents(df: DataFrame, native_id="NativeId", title="Title", content="Content",
                       date_decision="DateDecision") -> DataFrame:
    """Adds ``error`` (null when valid) and ``is_valid``."""
    def col_or_null(name):
        return F.col(name) if name in df.columns else F.lit(None).cast("string")
    err = validation_error(col_or_null(native_id), col_or_null(title), col_or_null(content),
                           col_or_null(date_decision))
    return df.withColumn("error", err).withColumn("is_valid", F.col("error").isNull())


def validation_report(validated: DataFrame, id_col: str, content: str = "Content", keep: int = 10) -> DataFrame:
    """Of validated rows: how many are valid, invalid, and valid without
    content, and the reasons of the first ``keep`` invalid ones by id."""
    firsts = validated.where(~F.col("is_valid")).select(id_col, "error").orderBy(id_col).limit(keep) \
        .agg(F.transform(F.array_sort(F.collect_list(F.struct(id_col, "error"))), lambda s: s["error"]).alias("first_errors"))
    counts = validated.agg(
        F.count(F.lit(1)).alias("checked"), F.count_if("is_valid").cast("long").alias("valid"),
        F.count_if(~F.col("is_valid")).cast("long").alias("invalid"),
        F.count_if(F.col("is_valid") & (F.coalesce(F.col(content), F.lit("")) == "")).cast("long").alias("valid_no_content"))
    return counts.join(F.broadcast(firsts))  # one row each


def date_range_error(start, end, now) -> Column:
    """start < end, start >= 2000-01-01, end <= now; else the message."""
    s, e, n = _c(start), _c(end), _c(now)
    fmt = lambda x: F.date_format(x, "yyyy-MM-dd HH:mm:ss")
    return (F.when(s >= e, F.concat(F.lit("Start date "), fmt(s), F.lit(" must be before end date "),
                                    fmt(e)))
            .when(s < F.lit("2000-01-01 00:00:00").cast("timestamp"),
                  F.concat(F.lit("Start date "), fmt(s),
                           F.lit(" is before minimum date 2000-01-01 00:00:00")))
            .when(e > n, F.concat(F.lit("End date "), fmt(e), F.lit(" is in the future"))))


def attachment_ok(file_uri, publicity, personal, size_bytes=None,
                  max_bytes: int = 50 * 1024 * 1024) -> Column:
    """Attachment gate: needs a URI; public (or unset) class; no personal data
    (or unset); size within the limit when known."""
    empty = lambda x: x.isNull() | (x == "")
    uri, pub, per = _c(file_uri), _c(publicity), _c(personal)
    ok = ~empty(uri) & (empty(pub) | (pub == "Julkinen")) & \
        (empty(per) | (per == "Ei sisällä henkilötietoja"))
    if size_bytes is not None:
        ok = ok & (_c(size_bytes).isNull() | (_c(size_bytes) <= max_bytes))
    return F.coalesce(ok, F.lit(False))


def content_outcome(known, content, markdown, chunks, embedded) -> Column:
    """Outcome of a requested document, the first that holds: indexed already,
    not there, without content, empty after conversion, without chunks, without
    the embedding of any chunk; else 'success'.  Counts that are null are 0."""
    number = lambda x: F.coalesce(_c(x), F.lit(0))
    return (F.when(F.coalesce(_c(known), F.lit(False)), "skipped")
            .when(_c(content).isNull(), "failed: missing").when(_c(content) == "", "failed: no content")
            .when(F.coalesce(T.py_strip(_c(markdown)), F.lit("")) == "", "failed: conversion empty")
            .when(number(chunks) == 0, "failed: no chunks").when(number(embedded) == 0, "failed: embedding")
            .otherwise("success"))
