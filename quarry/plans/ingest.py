"""The full ingestion job of a date window, in stages that are each written
once: window scan -> skip what is indexed -> validate -> HTML or plain text to
Markdown with its gate -> paragraph chunks with context header, attachments
included -> embed -> chunk store and embedding export -> outcome per document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import quality as Q
from quarry.operators.embedding import embed_texts
from quarry.operators.html_jobs import html_to_markdown
from quarry.operators.paragraph_chunker import ChunkSettings, paragraph_chunks
from quarry.session import shared_table
from quarry.sources import io
from quarry.sources.chunk_store import ChunkStore


def prepare_documents(decisions: DataFrame, existing: DataFrame, start: str, end: str) -> DataFrame:
    """Decisions of the window with their Markdown and header, or with the
    outcome that ends their way here.

    ``decisions`` has the flat decision columns and ``is_html``; ``existing``
    the ``NativeId`` of what is indexed already.  ISO texts order as their
    dates, so the bounds compare the raw column."""
    window = decisions.where((F.col("DateDecision") >= start) & (F.col("DateDecision") < end))
    known = existing.select("NativeId").distinct().withColumn("_known", F.lit(True))
    rows = Q.validate_documents(window.join(known, "NativeId", "left"))
    outcome = (F.when(F.col("_known"), "skipped")
               .when(~F.col("is_valid"), F.concat(F.lit("failed: "), F.col("error")))
               .when(F.coalesce(F.col("Content"), F.lit("")) == "", "failed: no content"))
    plain = T.clean_markdown(F.regexp_replace("Content", "\n", "\n\n"))
    rows = rows.select(
        "NativeId", F.substring("DateDecision", 1, 10).alias("batch_day"), outcome.alias("outcome"), "is_html",
        F.when(outcome.isNull(), F.when(F.col("is_html"), F.col("Content")).otherwise(plain)).alias("_content"),
        T.metadata_header("Title", "NativeId", "ClassificationTitle", "ClassificationCode",
                          "OrganizationName", "DateDecision", "CaseID", "Section").alias("header"))
    rows = html_to_markdown(rows, "_content", "markdown", is_html="is_html").drop("_content", "is_html")
    return rows.withColumn("outcome", F.coalesce("outcome", F.when(F.col("markdown") == "", "failed: conversion empty")))


def ingest(decisions: DataFrame, existing: DataFrame | None, attachments: DataFrame, start: str, end: str,
           embed_fn: Callable[[list[str]], list], *, model: str, store_path: str, export_path: str,
           settings: ChunkSettings = ChunkSettings(1000, 500, 1050, 100, 250)) -> DataFrame:
    """Run the job; one row per decision of the window: NativeId, batch_day,
    outcome ('successful', 'skipped' or 'failed: reason'), chunks,
    failed_chunks, attachments, attachment_chunks.

    ``attachments``: decision_native_id, attachment_native_id, FileURI,
    PublicityClass, PersonalData, text.  Those that pass the gate go with their
    decision if that is chunked.  Chunks without an embedding are not stored;
    ``failed_chunks`` counts them.  ``existing`` None: what the store at
    ``store_path`` holds is indexed already, so a second run adds to the first."""
    store = ChunkStore(decisions.sparkSession, store_path)
    if existing is None:
        existing = (store.read().select(F.col("decision_native_id").alias("NativeId")) if store.exists()
                    else decisions.select("NativeId").limit(0))
    prepared = shared_table(prepare_documents(decisions, existing, start, end), "prepared")
    ready = prepared.where(F.col("outcome").isNull())
    main = ready.select("NativeId", F.col("NativeId").alias("decision_native_id"), F.lit(False).alias("is_attachment"),
                        "batch_day", "markdown", "header")
    gated = attachments.where(Q.attachment_ok("FileURI", "PublicityClass", "PersonalData")) \
        .select("decision_native_id", "attachment_native_id", T.clean_markdown("text").alias("markdown"))
    extra = gated.where(T.markdown_ok("markdown")).join(
        ready.select(F.col("NativeId").alias("decision_native_id"), "batch_day", "header"), "decision_native_id").select(
        F.concat_ws("_", "decision_native_id", "attachment_native_id").alias("NativeId"), "decision_native_id",
        F.lit(True).alias("is_attachment"), "batch_day", "markdown", "header")
    about = ("decision_native_id", "is_attachment", "batch_day")
    chunks = paragraph_chunks(main.unionByName(extra), "markdown", "NativeId", settings, header_col="header", keep=about)
    rows = shared_table(embed_texts(chunks, "text", "chunk_id", embed_fn, model=model,
                                    keep=("NativeId", *about, "chunk_index", "text", "token_count")), "embedded")
    embedded = F.col("embedding").isNotNull()
    good = rows.where(embedded)
    store.upsert(good.drop("error", "model", "tokens_used"))
    io.write_embeddings(good.withColumnRenamed("NativeId", "native_id"), export_path, model, "batch_day")
    att = F.col("is_attachment")
    counts = rows.groupBy(F.col("decision_native_id").alias("NativeId")).agg(
        F.count_if(embedded & ~att).alias("chunks"), F.count_if(~embedded & ~att).alias("failed_chunks"),
        F.count_if(embedded & att & (F.col("chunk_index") == 0)).alias("attachments"),
        F.count_if(embedded & att).alias("attachment_chunks"))
    numbers = ("chunks", "failed_chunks", "attachments", "attachment_chunks")
    done = prepared.select("NativeId", "batch_day", "outcome").join(counts, "NativeId", "left").fillna(0, list(numbers))
    outcome = F.coalesce("outcome", F.when(F.col("chunks") > 0, "successful")
                         .when(F.col("failed_chunks") > 0, "failed: embedding").otherwise("failed: no chunks"))
    return done.select("NativeId", "batch_day", outcome.alias("outcome"), *numbers)
