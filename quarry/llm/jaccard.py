"""N-gram Jaccard join with count-vector R-trees.

A document's set holds the distinct shingles of five words.  Documents with
equal sets form a class; the join works on classes.

1. Shingles are hashed, packed and dealt by hash range with their classes, so
   each range counts in how many classes a shingle occurs.  Only shingles of
   two classes or more can be in an intersection.
2. Back at its class, a set needs at least three quarters of its shingles to
   be shared; few classes are left.  Its rarest shared shingles are its
   prefix: two linked classes have one in common (prefix filter).
3. Classes that meet through prefixes, directly or through others, are a
   cell.  In a cell, shingles are hashed into groups; the counts per group are
   a point, indexed by an R-tree.  The sum of the smaller coordinates bounds
   an intersection from above: nodes and points below the needed overlap go,
   and the surviving pairs are verified on their sets.
4. Cells of more than ``CELL`` classes are split into blocks by hash.  Blocks
   are linked inside first, then through one representative of each linked
   part; what is still outside the largest part is tested against every
   block.  So no link between parts is lost, and pairs within a part, which
   change nothing, are not enumerated.

A pair inside one part is skipped because the result is the class id (the
smallest document reachable), which such a pair cannot change.

Shingles and classes are compared by 64-bit hashes (58 bits or more for a
shingle); with n classes a false class is expected in n*n / 2**65 cases.

Defined results: null, empty and blank texts have empty sets, linked with
nothing; fewer than five words are one shingle; repeated rows are linked to
each other if they have a word; rows sharing an id share its component only
through their texts; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Rolling, bucket_count, ids_of, mix, slices, store, utf8
from quarry.llm.components import components

WORDS = 5
PERCENT = 75
CELL = 512  # classes in one block of a cell
LEAF = 16  # points in a leaf of an R-tree
FLUSH = 1 << 22  # shingles held by a task before it passes them on

U = np.uint64
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PLACES = mix(np.arange(1, WORDS + 1, dtype=np.uint64)) | U(1)
_ROLLING = Rolling(0x9E3779B97F4A7C15)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; ``data`` holds the texts'
    bytes and ``offsets`` their bounds."""
    text = _LOWER[data[offsets[0]:offsets[-1]]]
    bounds = offsets - offsets[0]
    prefix = _ROLLING.prefix(text)
    inside = ~_WHITE[text]
    step = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
    # a word also ends where its text does
    starts = np.union1d(np.flatnonzero(step == 1), bounds[:-1][(bounds[:-1] < len(text)) & inside[np.minimum(bounds[:-1], max(len(text) - 1, 0))]] if len(text) else [])
    starts = starts.astype(np.int64)
    stops = np.union1d(np.flatnonzero(step == -1), bounds[1:])
    ends = stops[np.searchsorted(stops, starts, "right")].astype(np.int64) if len(starts) else starts
    words = mix(_ROLLING.window(prefix, starts, ends) + (ends - starts).astype(U))
    first = np.searchsorted(starts, bounds)
    runs = np.zeros(max(0, len(words) - WORDS + 1), U)
    for k in range(WORDS):
        runs += words[k:len(runs) + k] * _PLACES[k]
    runs = mix(runs)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= WORDS:
            yield np.unique(runs[a:b - WORDS + 1])
        elif b > a:
            yield mix((words[a:b] * _PLACES[:b - a]).sum(keepdims=True) + U(b - a))
        else:
            yield np.zeros(0, U)


def _class_of(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    whole = mix(hashes * U(0xD6E8FEB86659FD93) + U(1)).sum() + U(len(hashes))
    return int(mix(np.array([whole], U))[0].view(np.int64)) or 1


def _needed(n: np.ndarray | int):
    """The least overlap that a set of n shingles needs with any partner."""
    return (PERCENT * n + 99) // 100


def _batch(names: list[str], types: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


_PACKED = (["bucket", "part", "classes", "rows"], [pa.int32(), pa.binary(), pa.binary(), pa.binary()])
_PACKED_SQL = "bucket int, part binary, classes binary, rows binary"


def _deal(buckets: int):
    """Task side of step 1: shingles by hash range, and the documents' rows by
    range of their class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held, owners, classes, rows, n = [], [], [], [], 0

        def flush():
            out = []
            if held:
                tokens = np.concatenate(held)
                owner = np.repeat(np.arange(len(classes), dtype=np.uint16), owners)
                place = ((tokens >> U(32)) * U(buckets) >> U(32)).astype(np.int64)
                order = np.argsort(place, kind="stable")
                cuts = np.searchsorted(place[order], np.arange(buckets + 1))
                table = np.array(classes, np.int64).tobytes()
                low, mid = tokens.astype(np.uint32)[order], (tokens >> U(32)).astype(np.uint16)[order]
                owner = owner[order]
                for b in range(buckets):
                    x, y = cuts[b], cuts[b + 1]
                    if y > x:
                        out.append((b, low[x:y].tobytes() + mid[x:y].tobytes() + owner[x:y].tobytes(), table, None))
            if rows:
                docs = np.array(rows, np.int64).reshape(-1, 3)
                place = docs[:, 2].view(U) % U(buckets)
                for b in np.unique(place):
                    out.append((int(b), None, None, docs[place == b].tobytes()))
            held.clear(), owners.clear(), classes.clear(), rows.clear()
            return _batch(*_PACKED, out)

        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            ids = ids_of(batch.column("doc_id"))
            for i, j in slices(offsets):
                for doc, hashes in zip(ids[i:j].tolist(), shingle_sets(data, offsets[i:j + 1])):
                    own = _class_of(hashes)
                    rows.append((doc, len(hashes), own))
                    if len(hashes) and own not in seen:  # an equal set of this task has been passed on
                        seen.add(own)
                        held.append(hashes)
                        owners.append(len(hashes))
                        classes.append(own)
                        n += len(hashes)
                    if n >= FLUSH or len(classes) == 65535:
                        yield flush()
                        n = 0
        if rows:
            yield flush()

    return run


def _share(buckets: int):
    """Step 1 in a hash range: shingles of two classes or more, sent to their
    classes with the number of classes (at most 65535, which keeps the order
    of shingles the same everywhere)."""

    def run(group: pa.Table) -> pa.Table:
        out, tokens, owners = [], [], []
        for bucket, part, table, rows in zip(*(group.column(c) for c in ("bucket", "part", "classes", "rows"))):
            if rows.is_valid:
                out.append((bucket.as_py(), None, None, rows.as_py()))
                continue
            raw, names = part.as_py(), np.frombuffer(table.as_py(), np.int64)
            n = len(raw) // 8
            tokens.append(np.frombuffer(raw, np.uint32, n).astype(U) | np.frombuffer(raw, np.uint16, n, 4 * n).astype(U) << U(32))
            owners.append(names[np.frombuffer(raw, np.uint16, n, 6 * n)])
        if tokens:
            high = U(group.column("bucket")[0].as_py()) << U(48)
            token, owner = np.concatenate(tokens), np.concatenate(owners)
            order = np.argsort(token, kind="stable")
            token, owner = token[order], owner[order]
            same = np.zeros(len(token) + 1, bool)
            same[1:-1] = token[1:] == token[:-1]
            some = same[:-1] | same[1:]
            token, owner = token[some], owner[some]
            order = np.lexsort((owner, token))
            token, owner = token[order], owner[order]
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
            token, owner = token[new], owner[new]
            begin = np.ones(len(token), bool)
            begin[1:] = token[1:] != token[:-1]
            run_ = np.cumsum(begin) - 1
            count = np.bincount(run_, minlength=1)[run_] if len(token) else np.zeros(0, np.int64)
            more = count > 1
            # where ranges are many, the bucket's number overlaps the 48 bits kept of the hash
            token, owner, count = token[more] ^ mix(np.array([high], U))[0], owner[more], np.minimum(count[more], 65535).astype(np.uint16)
            place = owner.view(U) % U(buckets)
            order = np.argsort(place, kind="stable")
            place = place[order]
            cuts = np.flatnonzero(np.diff(place)) + 1
            for rows in np.split(order, cuts) if len(order) else []:
                out.append((int(owner[rows[0]].view(U) % U(buckets)),
                            owner[rows].tobytes() + token[rows].tobytes() + count[rows].tobytes(), None, None))
        return pa.Table.from_batches([_batch(*_PACKED, out)])

    return run


def _gather(group: pa.Table) -> pa.Table:
    """Step 2: the documents of a class range, and its classes that have
    enough shared shingles, these sorted from rare to frequent."""
    owners, tokens, counts, rows = [], [], [], []
    for part, docs in zip(group.column("part"), group.column("rows")):
        if docs.is_valid:
            rows.append(np.frombuffer(docs.as_py(), np.int64).reshape(-1, 3))
            continue
        raw = part.as_py()
        n = len(raw) // 18
        owners.append(np.frombuffer(raw, np.int64, n))
        tokens.append(np.frombuffer(raw, U, n, 8 * n))
        counts.append(np.frombuffer(raw, np.uint16, n, 16 * n))
    names = ["doc_id", "n", "class", "shared"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    out = []
    docs = np.concatenate(rows) if rows else np.zeros((0, 3), np.int64)
    if owners:
        owner, token, count = np.concatenate(owners), np.concatenate(tokens), np.concatenate(counts)
        order = np.lexsort((token, count, owner))
        owner, token = owner[order], token[order]
        classes, at = np.unique(owner, return_index=True)
        size = np.diff(np.append(at, len(owner)))
        known, where = np.unique(docs[:, 2], return_index=True)
        n = docs[where, 1][np.searchsorted(known, classes)]
        for k in np.flatnonzero(size >= _needed(n)):
            out.append((None, int(n[k]), int(classes[k]), token[at[k]:at[k] + size[k]].tobytes()))
    void = -(1 << 63)
    table = pa.Table.from_arrays([pa.array(docs[:, 0], pa.int64(), mask=docs[:, 0] == void), pa.array(docs[:, 1]), pa.array(docs[:, 2]),
                                  pa.nulls(len(docs), pa.binary())], names)
    return pa.concat_tables([table, pa.Table.from_batches([_batch(names, types, out)])])


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, class) for the shared shingles of each prefix."""
    for batch in batches:
        tokens, owners = [], []
        for n, own, shared in zip(*(batch.column(c).to_pylist() for c in ("n", "class", "shared"))):
            token = np.frombuffer(shared, np.int64)
            # unshared shingles are the rarest and fill the prefix first
            length = n - int(_needed(n)) + 1 - (n - len(token))
            tokens.append(token[:length])
            owners.append(np.full(min(length, len(token)), own, np.int64))
        if tokens:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(np.concatenate(owners))], ["token", "class"])


class CountTree:
    """R-tree over count vectors, packed by size: inner boxes keep the largest
    coordinates below them and the smallest set."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray):
        self.vectors, self.sizes = vectors, sizes
        order = np.lexsort((vectors.argmax(1), sizes))
        self.levels = []  # from the leaves up: members of each node, boxes, smallest and largest sets
        members, box, low, high = [order[i:i + LEAF] for i in range(0, len(order), LEAF)], vectors, sizes, sizes
        while True:
            self.levels.append((members, np.array([box[m].max(0) for m in members]),
                                np.array([low[m].min() for m in members]), np.array([high[m].max() for m in members])))
            if len(members) <= LEAF:
                return
            _, box, low, high = self.levels[-1]
            members = [np.arange(i, min(i + LEAF, len(members))) for i in range(0, len(members), LEAF)]

    def search(self, vector: np.ndarray, size: int) -> np.ndarray:
        """Points whose bound reaches the overlap needed with ``size``."""
        nodes = np.arange(len(self.levels[-1][0]))
        for members, box, low, high in reversed(self.levels):
            bound = np.minimum(box[nodes], vector).sum(1)
            fits = ((bound * (100 + PERCENT) >= PERCENT * (size + low[nodes]))
                    & (100 * high[nodes] >= PERCENT * size) & (100 * size >= PERCENT * low[nodes]))
            nodes = np.concatenate([members[k] for k in nodes[fits]]) if fits.any() else np.zeros(0, np.int64)
        bound = np.minimum(self.vectors[nodes], vector).sum(1)
        return nodes[bound * (100 + PERCENT) >= PERCENT * (size + self.sizes[nodes])]


def count_vectors(sets: list[np.ndarray]) -> np.ndarray:
    """Counts per group of hashed shingles: 64 groups, more for larger sets
    (about a quarter of the median size), the same for a whole cell."""
    groups = 64
    while groups < min(1024, np.median([len(s) for s in sets]) / 4):
        groups *= 2
    out = np.zeros((len(sets), groups), np.int32)
    for k, s in enumerate(sets):
        out[k] = np.bincount((mix(s.view(U)) % U(groups)).astype(np.int64), minlength=groups)
    return out


class Parts:
    """Union-find by smallest name."""

    def __init__(self, names):
        self.up = {x: x for x in names}

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def link(sizes: np.ndarray, shared: list[np.ndarray], parts: list, probes: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links found between members of different parts, enough to join all
    linked parts; ``probes`` restricts one end of each pair."""
    sets = [np.sort(s) for s in shared]
    tree = CountTree(count_vectors(sets), sizes)
    joined, out = Parts(set(parts)), []
    for i in np.argsort(-sizes, kind="stable") if probes is None else probes:
        for j in tree.search(tree.vectors[i], int(sizes[i])):
            if i == j or joined.find(parts[i]) == joined.find(parts[j]):
                continue
            small, large = (i, j) if len(sets[i]) < len(sets[j]) else (j, i)
            at = np.searchsorted(sets[large], sets[small])
            common = int((sets[large][np.minimum(at, len(sets[large]) - 1)] == sets[small]).sum())
            if 100 * common >= PERCENT * (int(sizes[i]) + int(sizes[j]) - common):
                joined.join(parts[i], parts[j])
                out.append((int(i), int(j)))
    return out


def _link_group(group: pa.Table) -> pa.Table:
    """Links of a group of (class, n, shared, part, probe); parts as given."""
    # the same class may come as a probe and as a member
    owner = group.column("class").to_numpy()
    _, keep = np.unique(owner, return_index=True)
    probe = np.zeros(len(owner), bool)
    probe[np.isin(owner, owner[group.column("probe").to_numpy(zero_copy_only=False)])] = True
    owner, probe = owner[keep], probe[keep]
    group = group.take(pa.array(keep))
    shared = [np.frombuffer(x.as_py(), np.int64) for x in group.column("shared")]
    n, parts = group.column("n").to_numpy(), group.column("part").to_pylist()
    found = link(n, shared, parts, None if probe.all() else np.flatnonzero(probe))
    return pa.table({"src": pa.array([int(owner[i]) for i, _ in found], pa.int64()),
                     "dst": pa.array([int(owner[j]) for _, j in found], pa.int64())})


def _links(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.select(*keys, "class", "n", "shared", "part", "probe").groupBy(*keys).applyInArrow(_link_group, "src long, dst long")


def class_links(classes: DataFrame) -> DataFrame:
    """Steps 3 and 4: (src, dst) between linked classes; their connected
    components are those of all links.  ``classes``: class, n, shared."""
    meets = store(classes.select("n", "class", "shared").mapInArrow(_prefixes, "token long, class long"), "prefixes")
    centre = meets.groupBy("token").agg(F.min("class").alias("src"), F.count(F.lit(1)).alias("k")).where("k > 1").select("token", "src")
    stars = meets.join(centre, "token").where("src <> class").select("src", F.col("class").alias("dst")).distinct()
    cells = components(stars).select(F.col("node").alias("class"), F.col("label").alias("cell"))
    sizes = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("members"))
    blocks = F.ceil(F.col("members") / CELL).cast("int")
    members = store(
        classes.select("class", "n", "shared").join(cells.join(sizes, "cell"), "class")
        .withColumns({"blocks": blocks, "block": F.pmod(F.xxhash64("class"), blocks).cast("int"),
                      "part": F.col("class"), "probe": F.lit(True)}), "members")
    inside = store(_links(members, "cell", "block"), "links")
    large = members.where("blocks > 1")
    if not large.limit(1).count():
        return inside

    def with_parts(links: DataFrame) -> DataFrame:
        label = components(links).select(F.col("node").alias("class"), "label")
        return large.drop("part").join(label, "class", "left").withColumn("part", F.coalesce("label", "class")).drop("label")

    # one representative of each part, in blocks again
    heads = store(with_parts(inside).where("part = class"), "heads")
    count = heads.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("h"))
    between = store(_links(heads.join(count, "cell").withColumn("head_block", F.pmod(F.xxhash64("class"), "h")), "cell", "head_block"), "links")
    # what is not in the largest part of its cell, against every block of it
    now = store(with_parts(inside.union(between)), "parts")
    largest = (now.groupBy("cell", "part").agg(F.count(F.lit(1)).alias("k"))
               .groupBy("cell").agg(F.max(F.struct("k", "part")).alias("m")).select("cell", F.col("m.part").alias("most")))
    outside = store(now.join(largest, "cell").where("part <> most").drop("most"), "outside")
    groups = outside.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("g"))
    tagged = outside.join(groups, "cell").withColumn("probes", F.pmod(F.xxhash64("class"), "g").cast("int"))
    # each probe group goes to every block of its cell, and each block to every probe group of its cell
    probes = tagged.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("g")
    fixed = (now.join(groups, "cell").withColumn("probes", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
             .drop("g").withColumn("probe", F.lit(False)))
    last = store(_links(probes.unionByName(fixed), "cell", "block", "probes"), "links")
    return inside.union(between).union(last)


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    buckets = bucket_count(docs)
    packed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_deal(buckets), _PACKED_SQL)
    shared = packed.groupBy("bucket").applyInArrow(_share(buckets), _PACKED_SQL)
    both = store(shared.groupBy("bucket").applyInArrow(_gather, "doc_id long, n long, class long, shared binary"), "sets")
    rows = both.where("shared IS NULL").select("doc_id", "n", "class")
    found = components(class_links(both.where("shared IS NOT NULL").select("n", "class", "shared")))
    least = rows.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("m"))
    named = least.join(found.withColumnRenamed("node", "class"), "class", "left").select("class", "m", F.coalesce("label", "class").alias("label"))
    whole = named.groupBy("label").agg(F.min("m").alias("component_id"))
    of_class = store(named.join(whole, "label").select("class", "component_id"), "components")
    return rows.join(of_class, "class", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component: that with the smallest id, columns as
    they are.  Rows with the same doc_id stay or go together."""
    stay = join(docs).where("doc_id <=> component_id").select(F.col("doc_id").alias("__stay")).distinct()
    return docs.alias("d").join(stay.alias("s"), F.col("d.doc_id").eqNullSafe(F.col("s.__stay")), "left_semi")


OP6_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
r AS (WITH RECURSIVE r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a, min(b) AS c FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, r.c AS component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.a = d.doc_id
"""
