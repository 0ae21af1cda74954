"""Set-oriented operators for metadata, membership, roll-ups and ordering.

All are compositions of DataFrame operations; none collects rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.session import shared_table


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _nz(c) -> Column:
    """Null -> ''."""
    return F.coalesce(_c(c), F.lit(""))


# ---------------------------------------------------------------- projections
def _metadata_columns(collection: str) -> list[Column]:
    title = F.col("Title")
    src = F.when(title.isNotNull() & (title != ""), F.concat(title, F.lit(".md"))).otherwise(F.lit("Unknown Source"))
    dd = F.col("DateDecision")
    return [F.lit(collection).alias("collection_name"), src.alias("source"), src.alias("name"),
            _nz("NativeId").alias("file_id"), _nz("NativeId").alias("native_id"), _nz("Title").alias("title"),
            _nz("CaseID").alias("case_id"), _nz("Section").alias("section"),
            _nz("ClassificationCode").alias("classification_code"),
            _nz("ClassificationTitle").alias("classification_title"),
            F.when(dd.isNotNull() & (dd != ""), dd).alias("date_decision"),
            _nz("OrganizationName").alias("organization_name")]


def document_metadata(d: DataFrame, collection: str = "decisions") -> DataFrame:
    """Fixed metadata fields of a decision (flat decision columns in)."""
    return d.select("doc_id", *_metadata_columns(collection), F.lit(False).alias("is_attachment"))


def explode_attachments(decisions: DataFrame, id_col: str = "NativeId",
                        attachments: str = "Attachments", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per (decision, attachment) with the id fallback
    ``att_{AttachmentNumber or 1-based position}``; row-local (no shuffle)."""
    ex = decisions.select(*keep, id_col, F.posexplode(attachments).alias("position", "att"))
    num = F.col("att.AttachmentNumber")
    att_id = F.coalesce(F.nullif(F.col("att.NativeId"), F.lit("")),
                        F.concat(F.lit("att_"), F.coalesce(F.nullif(num, F.lit(0)), F.col("position") + 1)
                                 .cast("string")))
    return ex.select(*keep, F.col(id_col).alias("decision_native_id"), F.col("position").cast("long").alias("position"),
                     att_id.alias("attachment_native_id"), "att.*")


def attachment_metadata(decisions: DataFrame, collection: str = "decisions") -> DataFrame:
    """The parent's metadata and the attachment's fields, is_attachment=true;
    row-local, the parent is in the row that is exploded."""
    held = decisions.select("NativeId", "Attachments", F.struct(*_metadata_columns(collection)).alias("_meta"))
    return explode_attachments(held, keep=("_meta",)).select(
        "decision_native_id", "_meta.*", F.lit(True).alias("is_attachment"), "attachment_native_id",
        _nz("Title").alias("attachment_title"),
        F.coalesce("AttachmentNumber", F.lit(0)).cast("long").alias("attachment_number"),
        _nz("Type").alias("attachment_type"), _nz("FileURI").alias("attachment_url"))


def document_detail(decisions: DataFrame, attachments: str = "Attachments") -> DataFrame:
    """Detail view of a decision: title or 'Untitled', content or '', date,
    organization and metadata structs (null where the decision has none), and
    its attachments in order, projected in the row (null array: null)."""
    def have(name: str) -> Column:
        return F.col(name) if name in decisions.columns else F.lit(None).cast("string")

    att = decisions.schema[attachments].dataType.elementType.names
    fields = {"native_id": "NativeId", "title": "Title", "file_uri": "FileURI", "publicity_class": "PublicityClass",
              "type": "Type", "language": "Language"}
    shown = F.transform(attachments, lambda a: F.struct(*[
        (a[src] if src in att else F.lit(None).cast("string")).alias(name) for name, src in fields.items()]))
    name, org_id = have("OrganizationName"), have("OrganizationID")
    return decisions.select(
        have("NativeId").alias("native_id"), F.coalesce(F.nullif(have("Title"), F.lit("")), F.lit("Untitled")).alias("title"),
        _nz(have("Content")).alias("content"), have("DateDecision").alias("decision_date"),
        F.when(name.isNotNull() | org_id.isNotNull(), F.struct(org_id.alias("id"), name.alias("name"))).alias("organization"),
        have("ClassificationTitle").alias("classification"), shown.alias("attachments"),
        F.struct(have("CaseID").alias("diary_number"), have("Section").alias("section")).alias("metadata"))


#: Columns of a chunk that are stored beside its metadata.
CHUNK_FIELDS = ("native_id", "chunk_index", "token_count", "chunk_position", "start_index")


def chunk_index_rows(chunks: DataFrame, collection: Column, metadata: list[str], vector: str = "embedding") -> DataFrame:
    """The stored row of a chunk: collection, id, text, vector, a ``metadata``
    struct of its chunk fields and the named columns, and ``indexed_at``.
    Missing texts are stored as '', as their index fields are."""
    named = [c for c in (*CHUNK_FIELDS, *metadata) if c in chunks.columns]
    texts = {f.name for f in chunks.schema.fields if f.dataType.simpleString() == "string"}
    fields = [(_nz(f"`{c}`") if c in texts else F.col(f"`{c}`")).alias(c) for c in dict.fromkeys(named)]
    return chunks.select(collection.alias("collection"), F.col("chunk_id").alias("id"), _nz("text").alias("text"),
                         F.col(vector).alias("vector"), F.struct(*fields).alias("metadata"), F.current_timestamp().alias("indexed_at"))


# ---------------------------------------------------------------- membership
def document_exists(ids: DataFrame, store: DataFrame, id_col: str = "id",
                    own: str = "native_id", parent: str = "decision_native_id") -> DataFrame:
    """Flags per requested id: present as own id; present as own or parent id.

    Two equi joins against distinct key sets (an OR join condition would be
    a nested loop)."""
    own_keys = store.select(F.col(own).alias("_k")).where(F.col("_k").isNotNull()).distinct() \
        .withColumn("_own", F.lit(True))
    par_keys = store.select(F.col(parent).alias("_k")).where(F.col("_k").isNotNull()).distinct() \
        .withColumn("_par", F.lit(True))
    j = ids.join(own_keys, ids[id_col] == own_keys["_k"], "left").drop("_k")
    j = j.join(par_keys, j[id_col] == par_keys["_k"], "left").drop("_k")
    return j.select(id_col, F.coalesce("_own", F.lit(False)).alias("exists_own"),
                    (F.coalesce("_own", F.lit(False)) | F.coalesce("_par", F.lit(False)))
                    .alias("exists_own_or_parent"))


def delete_document(store: DataFrame, ids: DataFrame, id_col: str = "id",
                    own: str = "native_id", parent: str = "decision_native_id") -> DataFrame:
    """Rows kept after deleting every chunk whose own or parent id is listed
    (two equi anti joins instead of one OR join)."""
    k = ids.select(F.col(id_col).alias("_k")).distinct()
    kept = store.join(k, store[own] == k["_k"], "left_anti")
    # a row without a parent gets a key of its own, so that such rows are spread
    return kept.join(k, F.coalesce(kept[parent], F.concat(F.lit("\u0000"), kept[own])) == k["_k"], "left_anti")


def delete_attachments(store: DataFrame, ids: DataFrame, id_col: str = "id",
                       parent: str = "decision_native_id", flag: str = "is_attachment") -> DataFrame:
    """Rows kept after deleting the attachment chunks of the listed decisions."""
    k = ids.select(F.col(id_col).alias("_k")).distinct()
    # rows that are no attachments match nothing: a null key
    return store.join(k, F.when(store[flag], store[parent]) == k["_k"], "left_anti")


def delete_counts(store: DataFrame, kept: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """One row: ids asked for, ids deleted (an id that was not stored counts),
    ids that are still stored, and rows removed."""
    left = kept.select("native_id").join(ids.select(F.col(id_col).alias("native_id")), "native_id", "left_semi")
    total, failed = ids.agg(F.count(F.lit(1)).alias("total")), left.agg(F.count_distinct("native_id").alias("failed"))
    before, after = store.agg(F.count(F.lit(1)).alias("_b")), kept.agg(F.count(F.lit(1)).alias("_a"))
    joined = total.join(F.broadcast(failed)).join(F.broadcast(before)).join(F.broadcast(after))  # one row each
    return joined.select("total", (F.col("total") - F.col("failed")).alias("deleted"), "failed",
                         (F.col("_b") - F.col("_a")).alias("rows_removed"))


def upsert_latest(base: DataFrame, changes: DataFrame, key: str, order_col: str = "_version") -> DataFrame:
    """Insert-or-replace by key: every column of the newest row wins."""
    b = base.withColumn(order_col, F.lit(0))
    c = changes.withColumn(order_col, F.lit(1)) if order_col not in changes.columns else changes
    u = b.unionByName(c, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(F.col(order_col).desc())
    return u.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", order_col)


# ---------------------------------------------------------------- ordering
def with_global_index(df: DataFrame, order_cols: list[str], index_col: str = "row_index",
                      num_partitions: int | None = None) -> DataFrame:
    """0-based position in a total order, without a single-partition window.

    Rows are range-partitioned, sorted and written once to the shared folder
    with their partition and place in it; partition offsets are prefix sums
    over one count per partition (a table as small as the partition count,
    broadcast back).  The written table is counted and joined, so both see
    the same partitions.  Rows with equal keys are numbered in any order.
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    s = df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
    s = s.withColumn("_pid", F.spark_partition_id()) \
         .withColumn("_local", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33))
    s = shared_table(s, "ordered")
    return s.join(F.broadcast(_offsets(s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n")), _off="_n")), "_pid") \
        .withColumn(index_col, F.col("_off") + F.col("_local")).drop("_pid", "_local", "_off")


def _offsets(per_partition: DataFrame, **sums: str) -> DataFrame:
    """Sums over all partitions before each one (a row per partition)."""
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    return per_partition.select("_pid", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(name)
                                          for name, c in sums.items()])


def assign_batches(df: DataFrame, order_cols: list[str], batch_size: int) -> DataFrame:
    """Batch number floor(position / N) in the given order; last batch may be short."""
    g = with_global_index(df, order_cols, "_pos")
    return g.withColumn("batch_index", F.floor(F.col("_pos") / batch_size).cast("long")) \
        .withColumn("position", F.col("_pos")).drop("_pos")


def running_totals(df: DataFrame, order_cols: list[str], value_col: str, out: str = "running_total",
                   num_partitions: int | None = None) -> DataFrame:
    """Running sum in a total order (prefix sums per partition + offsets)."""
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    s = shared_table(df.repartitionByRange(n, *order_cols).withColumn("_pid", F.spark_partition_id()), "ordered")
    w_local = Window.partitionBy("_pid").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
    tot = s.groupBy("_pid").agg(F.sum(value_col).alias("_t"), F.count(F.lit(1)).alias("_c"))
    r = s.withColumn("_local_sum", F.sum(value_col).over(w_local)) \
         .withColumn("_local_n", F.count(F.lit(1)).over(w_local)) \
         .join(F.broadcast(_offsets(tot, _off="_t", _offn="_c")), "_pid")
    return r.withColumn(out, F.col("_off") + F.col("_local_sum")) \
        .withColumn("item_no", (F.col("_offn") + F.col("_local_n")).cast("long")) \
        .drop("_pid", "_local_sum", "_local_n", "_off", "_offn")


def paginate(df: DataFrame, order_cols: list[str], page: int, page_size: int) -> DataFrame:
    """Page ``page`` (1-based) of ``page_size`` rows in a deterministic order."""
    return df.orderBy(*order_cols).offset((page - 1) * page_size).limit(page_size)


class PageIndex:
    """A stored total order of ``df`` from which any page is read alone.

    Rows are range-partitioned by the order and written once, a folder per
    range; the directory holds the rows of each range.  A page opens the ranges
    that it lies in, so the last page costs as much as the first.  Rows of equal
    keys are side by side in any order, fixed when the index is made."""

    def __init__(self, df: DataFrame, order_cols: list[str], num_partitions: int | None = None):
        spark = df.sparkSession
        n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
        s = df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
        s = s.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
        self.rows = shared_table(s, "pages", "_part")
        sizes = self.rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("first")).orderBy("_part").collect()
        self.ranges, self.total = [], 0  # of each: folder, rows before it, rows, its first place
        for r in sizes:
            self.ranges.append((r["_part"], self.total, r["n"], r["first"]))
            self.total += r["n"]

    def pages(self, page_size: int) -> int:
        return max(-(-self.total // page_size), 1)

    def page(self, page: int, page_size: int) -> DataFrame:
        """Page ``page`` (1-based), in order; one that does not exist is empty."""
        low, high = (page - 1) * page_size, page * page_size
        held = [r for r in self.ranges if r[1] < high and r[1] + r[2] > low]
        mine = F.lit(False)
        for part, before, _, first in held:  # the places of the page in this range
            at = F.col("_at") - first + before
            mine = mine | ((F.col("_part") == part) & (at >= low) & (at < high))
        rows = self.rows.where(F.col("_part").isin([r[0] for r in held])).where(mine)
        return rows.orderBy("_part", "_at").drop("_part", "_at")


def latest_wins(df: DataFrame, key: list[str], order_cols: list[Column]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order_cols)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def trim_finished_runs(runs: DataFrame, group: list[str], order_cols: list[Column], keep: int, finished: Column) -> DataFrame:
    """The newest ``keep`` finished runs of each group; runs that are not
    finished (``finished`` false or null) all stay and take no place."""
    done = F.coalesce(finished, F.lit(False))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order_cols))
    newest = runs.where(done).withColumn("_rn", rank).where(F.col("_rn") <= keep).drop("_rn")
    return newest.unionByName(runs.where(~done))


def distinct_by_min(df: DataFrame, key_col: str, id_col: str) -> DataFrame:
    """One row per key, the one with the smallest id (partial aggregation
    with min_by; groups are never sorted or collected)."""
    others = [c for c in df.columns if c not in (key_col, id_col)]
    return df.groupBy(key_col).agg(F.min(id_col).alias(id_col),
                                   *[F.min_by(c, F.col(id_col)).alias(c) for c in others])
