"""Conversation prefix trie by ROLLUP over positional turn-id columns.

A conversation is a sequence of turns below an empty root turn.  It is laid out
in rows of ``WIDTH`` positional columns t1..tW that hold digests of turns; a
conversation longer than that goes on in further rows, whose key is the node
that the row before ended at.  One ``GROUP BY block, node, ROLLUP (t1, ...)``
then makes every node of the trie, and ``grouping_id`` tells its depth.

The node that a row ends at is known without building the trie: it is named by
128 bits, the exclusive or of position-dependent hashes of all turns so far.
So all blocks are rolled up at once, however long conversations are.

What a node counts in its subtree needs no descent either.  A node belongs to
its smallest member; the nodes of one conversation are the rest of its path
from some depth on.  Hence sums over the subtree of a node are sums, over its
members, of what each owns from that depth on, and a second ROLLUP adds them.

Rows of one conversation are split by position wherever they are ordered, nodes
are pre-aggregated before they are dealt out, and the ids that end at one node
are hashed as a stream, so no group has to fit in a task.

Defined results: rows without a conv_id are left out; a null turn comes first,
turns of equal number are ordered by the digest of role and text; null role and
text are empty; repeated rows are turns each; negative ids take part, the
remainder has the sign of the id; other columns are ignored, whatever their
names; an empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import store

WIDTH = 8
HEADS = 9  # a rebuilt conversation takes fewer than so many turns of its family's first one
FAMILY = 5
#: Positions, or blocks, of one conversation that are ordered together.
CHUNK = 4096
NODE = ("x1", "x2", "depth")


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, tid (digest of role and text), n_bytes of the text."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    return conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32).alias("tid"),
        F.octet_length(text).cast("long").alias("n_bytes"))


def with_positions(rows: DataFrame) -> DataFrame:
    """``pos`` of each row in its conversation, from 1, by turn and digest.

    Rows are range-partitioned by conversation and turn, so one conversation
    may lie on many partitions; a partition's share of it is a span, and the
    spans before it say where it starts."""
    order = ["conv_id", F.asc_nulls_first("turn"), "tid"]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    held = store(held.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "turns")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = (held.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
             .select("conv_id", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1).alias("shift")))
    return held.join(spans, ["conv_id", "part"]).select("conv_id", "tid", "n_bytes", (F.col("at") + F.col("shift")).alias("pos"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """The rows of ``shared_paths``: conv_id, depth from 0, tid, n_bytes, and the
    number of turns ``n`` of each rebuilt conversation.

    Conversation c starts with the first h turns of c - c % 5 and goes on with
    its own turns after its first h; h is the CRC-32 of its decimal id modulo 9.
    The row of depth 0 is the root's."""
    rows = store(with_positions(turns(conversations)), "positions")
    own = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_own"))
    heads = rows.where((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < HEADS))
    n_heads = heads.groupBy(F.col("conv_id").alias("base")).agg(F.count(F.lit(1)).alias("n_base"))
    convs = store(
        own.withColumns({"h": F.crc32(F.col("conv_id").cast("string")) % HEADS, "base": F.col("conv_id") - F.col("conv_id") % FAMILY})
        .join(n_heads, "base", "left")
        .withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0))))
        .select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))).alias("n")),
        "conversations")
    first = heads.select(F.col("conv_id").alias("base"), "tid", "n_bytes", "pos").join(convs, "base").where("pos <= h")
    rest = rows.join(convs, "conv_id").where("pos > h")
    kept = ("conv_id", "tid", "n_bytes", "n")
    return (convs.select("conv_id", F.lit("").alias("tid"), F.lit(0).cast("long").alias("n_bytes"), "n", F.lit(0).cast("long").alias("depth"))
            .unionByName(first.select(*kept, F.col("pos").alias("depth")))
            .unionByName(rest.select(*kept, (F.col("pos") - F.col("h") + F.col("taken")).alias("depth"))))


def _running(df: DataFrame, at: str, columns: dict[str, tuple[str, str]], later: bool = False) -> DataFrame:
    """Adds to each row what aggregates over the rows of its conversation before
    it (or ``later``, after it) give: name -> (column, 'sum' or 'bit_xor').
    Totals of chunks stand for the chunks before, so a window holds a chunk."""
    order = F.desc if later else F.asc
    aggregate = {"sum": F.sum, "bit_xor": F.bit_xor}
    parts = df.withColumn("chunk", F.floor(F.col(at) / CHUNK))
    outer = Window.partitionBy("conv_id").orderBy(order("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    inner = Window.partitionBy("conv_id", "chunk").orderBy(order(at)).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    sums = parts.groupBy("conv_id", "chunk").agg(*[aggregate[how](c).alias(f"s_{k}") for k, (c, how) in columns.items()])
    sums = sums.select("conv_id", "chunk", *[F.coalesce(aggregate[how](f"s_{k}").over(outer), zero).alias(f"s_{k}")
                                             for k, (_, how) in columns.items()])
    out = parts.join(sums, ["conv_id", "chunk"])
    for k, (c, how) in columns.items():
        near, far = F.coalesce(aggregate[how](c).over(inner), zero), F.col(f"s_{k}")
        out = out.withColumn(k, near + far if how == "sum" else near.bitwiseXOR(far))
    return out.drop("chunk", *[f"s_{k}" for k in columns])


def _names(depth: Column, tid: Column) -> tuple[Column, Column]:
    """Two hashes of a turn at its depth; 0 where there is none."""
    zero = F.lit(0).cast("long")
    return (F.when(tid.isNull(), zero).otherwise(F.xxhash64(tid, depth)),
            F.when(tid.isNull(), zero).otherwise(F.xxhash64(depth, F.lit("node"), tid)))


def _depth(j: int) -> Column:
    """Of the turn in column j of a block."""
    return F.col("block") * WIDTH + (j - 1)


def _xor(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out.bitwiseXOR(c)
    return out


def _columns() -> list[str]:
    return [f"t{j}" for j in range(1, WIDTH + 1)]


def blocks(paths: DataFrame) -> DataFrame:
    """Rows of positional columns: t1..tW, the turns' bytes b1..bW, and the name
    (p1, p2) of the node that the conversation's earlier rows end at."""
    slot = F.col("depth") % WIDTH + 1
    rows = paths.groupBy("conv_id", F.floor(F.col("depth") / WIDTH).alias("block")).agg(
        F.max("n").alias("n"),
        *[F.max(F.when(slot == j, F.col("tid"))).alias(f"t{j}") for j in range(1, WIDTH + 1)],
        *[F.max(F.when(slot == j, F.col("n_bytes"))).alias(f"b{j}") for j in range(1, WIDTH + 1)])
    names = [_names(_depth(j), F.col(f"t{j}")) for j in range(1, WIDTH + 1)]
    rows = store(rows.withColumns({"x1": _xor([a for a, _ in names]), "x2": _xor([b for _, b in names])}), "blocks")
    return _running(rows, "block", {"p1": ("x1", "bit_xor"), "p2": ("x2", "bit_xor")})


def _rolled(rows: DataFrame, aggregates: list[str]) -> DataFrame:
    """Every node: its columns, its ``level`` in its block and aggregates over
    its members.  Rollup levels that no turn reaches are no nodes."""
    columns = _columns()
    rolled = rows.sparkSession.sql(
        f"SELECT block, p1, p2, {', '.join(columns)}, {WIDTH} - bit_count(grouping_id()) AS level, {', '.join(aggregates)} "
        f"FROM {{rows}} GROUP BY block, p1, p2, ROLLUP ({', '.join(columns)})", rows=rows)
    return (rolled.where("level > 0").where(F.get(F.array(*columns), F.col("level") - 1).isNotNull())
            .withColumn("depth", F.col("block") * WIDTH + F.col("level") - 1))


def _pick(values: list[Column], at: Column) -> Column:
    return F.get(F.array(*values), at)


def _owned(rows: DataFrame) -> DataFrame:
    """``blocks`` with what each conversation owns: m1..mW, the members of a node
    that it is the smallest member of, and whether it owns a ``leaf``."""
    nodes = _rolled(rows, ["min(conv_id) AS conv_id", "count(*) AS n_convs", "max(n) AS longest"])
    own = nodes.groupBy("conv_id", "block").agg(
        *[F.max(F.when(F.col("level") == j, F.col("n_convs"))).alias(f"m{j}") for j in range(1, WIDTH + 1)],
        F.max((F.col("longest") == F.col("depth")).cast("long")).alias("leaf"))
    return rows.join(own, ["conv_id", "block"], "left")


def _shares(rows: DataFrame) -> DataFrame:
    """Per conversation and block: v_j, the bytes that its own node in column j
    saves, o_j, whether it owns the node after column j, and sums over later
    blocks (``later``); ``leaf`` counts in every block up to the leaf's."""
    zero = F.lit(0).cast("long")
    marked = rows.withColumns({
        **{f"v{j}": F.coalesce((F.col(f"m{j}") - 1) * F.col(f"b{j}"), zero) for j in range(1, WIDTH + 1)},
        **{f"own{j}": F.col(f"m{j}").isNotNull().cast("long") for j in range(1, WIDTH + 1)},
        "leaf": F.coalesce("leaf", zero)})
    marked = marked.withColumns({"v": sum((F.col(f"v{j}") for j in range(1, WIDTH + 1)), zero),
                                 "own": sum((F.col(f"own{j}") for j in range(1, WIDTH + 1)), zero)}).drop("m1")
    marked = _running(marked, "block", {"later": ("v", "sum"), "own_later": ("own", "sum"), "leaf_later": ("leaf", "sum")}, later=True)
    rest = F.col("n") + 1 - (F.col("block") + 1) * WIDTH  # positions in later blocks; owned ones are the last ones
    return marked.select(
        "conv_id", "block", "p1", "p2", "n", *_columns(), *[f"v{j}" for j in range(1, WIDTH + 1)], "later",
        *[F.col(f"own{j + 1}").alias(f"o{j}") for j in range(1, WIDTH)],
        ((rest > 0) & (F.col("own_later") == rest)).cast("long").alias(f"o{WIDTH}"),
        (F.col("leaf") + F.col("leaf_later")).alias("leaf"))


def _with_names(nodes: DataFrame) -> DataFrame:
    """Adds the names of a node and of its parent."""
    at = [_names(_depth(j), F.col(f"t{j}")) for j in range(1, WIDTH + 1)]  # columns beyond the level are null
    x1, x2 = _xor([F.col("p1"), *[a for a, _ in at]]), _xor([F.col("p2"), *[b for _, b in at]])
    last = _names(F.col("depth"), _pick([F.col(c) for c in _columns()], F.col("level") - 1))
    return nodes.withColumns({"x1": x1, "x2": x2}).withColumns(
        {"q1": F.col("x1").bitwiseXOR(last[0]), "q2": F.col("x2").bitwiseXOR(last[1])})


def _ends(rows: DataFrame) -> DataFrame:
    """SHA-256 of the ids, in order and joined by commas, of the conversations
    that end at a node.

    Ids are sorted over all partitions by node and id; a partition writes runs
    of at most 8,192 ids as text, and one task per node hashes its runs as they
    come in."""
    at = [_names(_depth(j), F.col(f"t{j}")) for j in range(1, WIDTH + 1)]
    last = rows.where(F.floor(F.col("n") / WIDTH) == F.col("block")).select(
        _xor([F.col("p1"), *[a for a, _ in at]]).alias("x1"), _xor([F.col("p2"), *[b for _, b in at]]).alias("x2"),
        F.col("n").alias("depth"), "conv_id")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            x1, x2, depth, conv = (c.to_numpy() for c in batch.columns)
            new = np.flatnonzero((np.diff(x1) != 0) | (np.diff(x2) != 0) | (np.diff(depth) != 0)) + 1
            cuts = np.unique(np.concatenate([[0], new, np.arange(0, len(conv), 8192)]).astype(np.int64))
            text = [",".join(map(str, c.tolist())) for c in np.split(conv, cuts[1:])] if len(conv) else []
            cuts = cuts[:len(text)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x1[cuts]), pa.array(x2[cuts]), pa.array(depth[cuts]), pa.array([part] * len(text), pa.int32()),
                 pa.array(np.arange(number, number + len(text))), pa.array(text, pa.string())],
                ["x1", "x2", "depth", "part", "run", "ids"])
            number += len(text)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            done = []
            for *node, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if node == key:
                    state.update(b"," + ids.encode())
                    continue
                if key is not None:
                    done.append((*key, state.hexdigest()))
                key, state = node, hashlib.sha256(ids.encode())
            yield _digests(done)
        if key is not None:
            yield _digests([(*key, state.hexdigest())])

    def _digests(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * 4
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())],
                                          [*NODE, "ends_sha256"])

    texts = (last.repartitionByRange(n, *NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
             .mapInArrow(runs, "x1 long, x2 long, depth long, part int, run long, ids string"))
    return (texts.repartition(n, *NODE).sortWithinPartitions(*NODE, "part", "run").select(*NODE, "ids")
            .mapInArrow(digests, "x1 long, x2 long, depth long, ends_sha256 string"))


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id (its smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens and ends_sha256."""
    return trie_of(rebuilt(conversations))


def trie_of(paths: DataFrame) -> DataFrame:
    """The trie of any paths: conv_id, depth from 0 (the root's row, with the
    same tid for all), tid, n_bytes, and the last depth ``n``."""
    rows = store(_shares(_owned(store(blocks(paths), "paths"))), "shares")
    each = range(1, WIDTH + 1)
    counted = _rolled(rows, ["min(conv_id) AS conv_id", "count(*) AS n_convs", "sum(leaf) AS n_leaves", "sum(later) AS later",
                             *[f"sum(v{j}) AS v{j}" for j in each], *[f"sum(o{j}) AS o{j}" for j in each]])
    to_end = [sum((F.col(f"v{i}") for i in range(j, WIDTH + 1)), F.col("later")) for j in each]
    level = F.col("level") - 1
    nodes = store(_with_names(counted).select(
        "conv_id", "depth", "x1", "x2", "q1", "q2", "n_convs",
        _pick([F.col(f"o{j}") for j in each], level).alias("n_children"), "n_leaves",
        _pick(to_end, level).alias("saved_tokens")), "nodes")
    parents = nodes.select(F.col("x1").alias("q1"), F.col("x2").alias("q2"), (F.col("depth") + 1).alias("depth"),
                           F.col("conv_id").alias("parent_conv_id"))
    return (nodes.join(parents, ["q1", "q2", "depth"], "left").join(_ends(rows), list(NODE), "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")))


OP13_SQL = r"""
WITH RECURSIVE bits AS (SELECT i AS n, i AS c, 0 AS k FROM range(256) r(i)
    UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY n) AS crc FROM bits WHERE k = 8),
t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos,
        sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS tid, strlen(coalesce(text, ''))::BIGINT AS b
      FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base,
        xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii((conv_id::VARCHAR)[i])::BIGINT)),
            lambda a, x: xor(a >> 8, crc[(xor(a, x) & 255) + 1])), 4294967295) % 9 AS h
      FROM (SELECT DISTINCT conv_id FROM t), crc),
r AS (SELECT c.conv_id, t.pos, t.tid, t.b FROM c JOIN t ON t.conv_id = c.base AND t.pos <= c.h
      UNION ALL SELECT c.conv_id, t.pos + 100, t.tid, t.b FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h),
p AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS depth, tid, b FROM r),
l AS (SELECT conv_id, list(tid ORDER BY depth) AS path, list(b ORDER BY depth) AS b FROM p GROUP BY 1),
m AS (SELECT c.conv_id, coalesce(l.path, []) AS path, coalesce(l.b, []) AS b FROM c LEFT JOIN l USING (conv_id)),
e AS (SELECT conv_id, path, unnest(range(0, len(path) + 1)) AS depth, b FROM m),
n AS (SELECT depth, sha256(array_to_string(path[1:depth], ',')) AS node, sha256(array_to_string(path[1:greatest(depth - 1, 0)], ',')) AS parent,
        min(conv_id) AS conv_id, count(*) AS n_convs, any_value(path[1:depth]) AS path, any_value(CASE WHEN depth > 0 THEN b[depth] ELSE 0 END) AS b,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len(path) = depth), '')) AS ends_sha256
      FROM e GROUP BY 1, 2, 3),
k AS (SELECT parent, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1, 2),
f AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k ON k.parent = n.node AND k.depth = n.depth),
u AS (SELECT unnest(range(0, depth + 1)) AS depth, path, (n_convs - 1) * b AS saved, (n_children = 0)::BIGINT AS leaf FROM f),
s AS (SELECT depth, sha256(array_to_string(path[1:depth], ',')) AS node, sum(saved) AS saved_tokens, sum(leaf) AS n_leaves FROM u GROUP BY 1, 2)
SELECT f.conv_id, f.depth::BIGINT AS depth, q.conv_id AS parent_conv_id, f.n_convs::BIGINT AS n_convs, f.n_children::BIGINT AS n_children,
  s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, f.ends_sha256
FROM f JOIN s ON s.node = f.node AND s.depth = f.depth LEFT JOIN n q ON q.node = f.parent AND q.depth = f.depth - 1 AND f.depth > 0
"""
