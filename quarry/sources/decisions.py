"""Decision documents: schema, and the stand-in mapping from ``documents``.

The shared test tables hold plain ``documents``; decisions are derived from
them by a fixed rule so that every metadata operator has dated, titled,
classified rows to work on (the same rule is written in SQL for the oracle).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DECISION_SCHEMA = (
    "NativeId string, Title string, CaseIDLabel string, Section string, Content string, "
    "ClassificationCode string, ClassificationTitle string, "
    "Organization struct<Name:string, ID:string, TypeId:string, Type:string, "
    "Sector:struct<Sector:string>>, "
    "Attachments array<struct<Title:string, Type:string, FileURI:string, PublicityClass:string, "
    "AttachmentNumber:int, NativeId:string, SecurityReasons:array<string>, PersonalData:string, "
    "Language:string>>, DateDecision string, CaseID string"
)


def decisions_from_documents(docs: DataFrame) -> DataFrame:
    """documents(doc_id, text, lang, source) -> flat decision columns."""
    day = F.date_format(F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("doc_id") % 60).cast("int")),
                        "yyyy-MM-dd")
    return docs.select(
        "doc_id",
        F.concat(F.lit("DOC-"), F.col("doc_id").cast("string")).alias("NativeId"),
        F.regexp_extract("text", r"^([^\n.]*)", 1).alias("Title"),
        F.col("text").alias("Content"),
        F.upper("lang").alias("ClassificationCode"),
        F.col("lang").alias("ClassificationTitle"),
        F.col("source").alias("OrganizationName"),
        F.when(F.col("doc_id") % 3 == 1, day)
         .when(F.col("doc_id") % 3 == 2, F.concat(day, F.lit("T10:00:00.000"))).alias("DateDecision"),
        F.when(F.col("doc_id") % 4 != 0,
               F.concat(F.lit("HEL 2024-"), F.lpad(F.col("doc_id").cast("string"), 6, "0"))).alias("CaseID"),
        F.when(F.col("doc_id") % 5 == 0, F.lit("")).otherwise((F.col("doc_id") % 40).cast("string"))
         .alias("Section"),
    )


DECISIONS_SQL = r"""
decisions AS (
  SELECT doc_id,
         'DOC-' || CAST(doc_id AS VARCHAR) AS NativeId,
         regexp_extract(text, '^([^\n.]*)', 1) AS Title,
         text AS Content,
         upper(lang) AS ClassificationCode,
         lang AS ClassificationTitle,
         source AS OrganizationName,
         CASE WHEN doc_id % 3 = 1 THEN strftime(DATE '2024-01-01' + CAST(doc_id % 60 AS INTEGER), '%Y-%m-%d')
              WHEN doc_id % 3 = 2 THEN strftime(DATE '2024-01-01' + CAST(doc_id % 60 AS INTEGER), '%Y-%m-%d') || 'T10:00:00.000'
         END AS DateDecision,
         CASE WHEN doc_id % 4 <> 0 THEN 'HEL 2024-' || lpad(CAST(doc_id AS VARCHAR), 6, '0') END AS CaseID,
         CASE WHEN doc_id % 5 = 0 THEN '' ELSE CAST(doc_id % 40 AS VARCHAR) END AS Section
  FROM documents
)
"""
