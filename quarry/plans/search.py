"""Composed retrieval jobs: corpus chunks with vectors, query vectors, top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions import vectors as V
from quarry.operators import chunking, quality, retrieval
from quarry.operators.partitioning import fan_out
from quarry.operators.search_filters import metadata_filter
from quarry.session import shared_table

DIMS = 64


def valid_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents that pass the id and content rules, with cleaned text."""
    ok = quality.valid_native_id(id_col) & F.col(text_col).isNotNull() & (F.col(text_col) != "")
    return docs.where(ok).withColumn(text_col, T.clean_markdown(text_col))


def chunk_vectors(docs: DataFrame, size: int = 400, overlap: int = 50, dims: int = DIMS,
                  keep: tuple[str, ...] = ()) -> DataFrame:
    """documents -> validated, cleaned -> fixed token windows -> hash vectors."""
    base = valid_documents(fan_out(docs.select("doc_id", "text", *keep), "doc_id"))
    ch = chunking.fixed_token_chunks(base, "text", "doc_id", size, overlap, keep=keep)
    return V.with_hash_embedding(ch, "chunk_tokens", dims, "embedding")


def hit_texts(hits: DataFrame, docs: DataFrame, size: int = 400, overlap: int = 50,
              keep: tuple[str, ...] = ()) -> DataFrame:
    """The hits with the text of their chunks and columns of their documents,
    cut again from the documents that were hit: texts stay out of the scoring."""
    base = valid_documents(docs.select("doc_id", "text", *keep).join(hits.select("doc_id").distinct(), "doc_id", "left_semi"))
    chunks = chunking.fixed_token_chunks(base, "text", "doc_id", size, overlap, keep=keep)
    return hits.join(chunks.select("chunk_id", "text", *keep), "chunk_id")


def query_vectors(queries: DataFrame, id_col: str = "item_id", text_col: str = "text",
                  dims: int = DIMS) -> DataFrame:
    return V.with_hash_embedding(queries.select(id_col, T.tokens(text_col).alias("_tok")), "_tok", dims,
                                 "embedding")


def search(docs: DataFrame, queries: DataFrame, k: int, *, date_gte: str | None = None, date_lte: str | None = None,
           equals: dict | None = None, snippet: int = 500) -> DataFrame:
    """Filtered search: date and equality filters before scoring, k best
    chunks per query, each with title, snippet, date and organisation."""
    about = ("Title", "DateDecision", "OrganizationName")
    docs = metadata_filter(docs, "DateDecision", date_gte, date_lte, equals)
    hits = shared_table(retrieval.knn_search(chunk_vectors(docs), query_vectors(queries), k, qid="item_id",
                                             carry=["doc_id"]), "hits")
    title = F.when(F.coalesce(F.col("Title"), F.lit("")) != "", F.col("Title")).otherwise("Untitled")
    return hit_texts(hits, docs, keep=about).select(
        "item_id", F.col("rank").cast("long").alias("rank"), "chunk_id", title.alias("title"),
        F.substring("text", 1, snippet).alias("snippet"), "score", F.col("DateDecision").alias("date_decision"),
        F.col("OrganizationName").alias("organization"))


def benchmark_top_k(docs: DataFrame, bench: DataFrame, k: int = 10) -> DataFrame:
    """Every benchmark query's k best chunks by cosine."""
    corpus = chunk_vectors(docs)
    q = query_vectors(bench)
    hits = retrieval.knn_search(corpus, q, k, qid="item_id", cid="chunk_id", vec="embedding",
                                carry=["doc_id"])
    return hits.select("item_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "doc_id",
                       "score")
