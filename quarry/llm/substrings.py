"""Removal of byte strings that occur more than once, by a difference cover.

A difference cover D modulo v has, for any two positions, a shift below v that
takes both to sampled positions (their remainder is in D).  So two equal
strings of ``LENGTH`` bytes contain, at one shift, two sampled windows of
``LENGTH - v + 1`` bytes that are equal.

1. Sampled windows are named by hashes, packed and dealt by name; sorting puts
   equal names side by side, and names met once go.
2. The recursion works on what is left: positions within v of a repeated
   sample.  All suffixes there are merged with one another by the name of
   their ``LENGTH``-byte prefix, sorted, and adjacent prefixes compared.
   A position whose prefix occurs twice starts a repeated string.
3. Each text's repeated strings are united into spans.

Only prefixes of ``LENGTH`` bytes matter, so suffixes are ordered by names of
64 bits rather than byte by byte, and the full suffix array is not written.
The first names keep 32 bits besides their range; a false one costs work in
step 2, nothing else.  The second have 64 bits and a range of independent bits.

Whole texts that are equal have one name (SHA-256): one of them takes part,
and all of them are removed whole if they have ``LENGTH`` bytes.

Defined results: null counts as the empty text; a shorter text than
``LENGTH`` stays whole; repeated rows remove one another; rows sharing an id
are told apart by their texts; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Rolling, bucket_count, ids_of, mix, slices, store, utf8

LENGTH = 400
U = np.uint64
FLUSH = 1 << 22  # sampled windows held by a task before it passes them on
UNIT = 4 << 20  # bytes of text in a unit of step 2
# Bits of the filter that spares moving texts without repeats; least, most, and for each wanted text.
FILTER_BITS, MOST_BITS, BITS_A_TEXT = 1 << 23, 1 << 27, 16


def difference_cover(r: int) -> tuple[int, np.ndarray]:
    """Period v and remainders D by the Colbourn-Ling construction."""
    steps = [1] * r + [r + 1] + [2 * r + 1] * r + [4 * r + 3] * (2 * r + 1) + [2 * r + 2] * (r + 1) + [1] * r
    return 24 * r * r + 36 * r + 13, np.concatenate(([0], np.cumsum(steps)))


PERIOD, COVER = difference_cover(2)
WINDOW = LENGTH - PERIOD + 1
_FIRST, _SECOND = Rolling(0x9E3779B97F4A7C15), Rolling(0xC2B2AE3D27D4EB4F)


def sampled(n: int) -> np.ndarray:
    """Sampled window starts of a text of n bytes."""
    rounds = np.arange(0, max(0, n - WINDOW + 1), PERIOD)[:, None] + COVER
    return rounds[rounds <= n - WINDOW]


def _table(names, types, rows) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


_NAMES = ["bucket", "flush", "part", "docs"]
_TYPES = [pa.int32(), pa.string(), pa.binary(), pa.binary()]
_SQL = "bucket int, flush string, part binary, docs binary"
_DOC = np.dtype([("id", "<i8"), ("n", "<i8"), ("at", "<i8"), ("sha", "V32")])


def _deal(buckets: int):
    """Step 1, task side: names by range; and the documents of each flush."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        names, places, docs, at, count, flushes = [], [], [], 0, 0, 0
        task = TaskContext.get().partitionId()

        def flush():
            key = f"{task}-{flushes}"
            out = [(hash_of(key) % buckets, key, None, np.array(docs, _DOC).tobytes())]
            if names:
                name, place = np.concatenate(names), np.concatenate(places)
                bucket = ((name >> U(32)) * U(buckets) >> U(32)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                name, place = name.astype(np.uint32)[order], place[order]
                for b in range(buckets):
                    x, y = cuts[b], cuts[b + 1]
                    if y > x:
                        out.append((b, key, name[x:y].tobytes() + place[x:y].tobytes(), None))
            names.clear(), places.clear(), docs.clear()
            return _table(_NAMES, _TYPES, out).combine_chunks().to_batches()[0]

        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            ids = ids_of(batch.column("doc_id"))
            for i, j in slices(offsets):
                part = data[offsets[i]:offsets[j]]
                prefix = _FIRST.prefix(part)
                starts = []
                for k in range(i, j):
                    a, b = int(offsets[k] - offsets[i]), int(offsets[k + 1] - offsets[i])
                    sha = hashlib.sha256(part[a:b]).digest()
                    if b - a < LENGTH or sha in seen:
                        docs.append((ids[k], b - a, -1, sha))
                        continue
                    seen.add(sha)
                    own = sampled(b - a)
                    docs.append((ids[k], b - a, at, sha))
                    starts.append(own + a)
                    places.append((own + at).astype(np.uint32))
                    at += b - a
                    count += len(own)
                if starts:
                    start = np.concatenate(starts)
                    names.append(mix(_FIRST.window(prefix, start, start + WINDOW)))
                if count >= FLUSH or len(docs) >= 1 << 18:
                    yield flush()
                    at, count, flushes = 0, 0, flushes + 1
        if docs:
            yield flush()

    return run


def hash_of(key: str) -> int:
    return int.from_bytes(hashlib.blake2b(key.encode(), digest_size=4).digest(), "little")


def _repeated_samples(group: pa.Table) -> pa.Table:
    """Step 1 in a range of names: places of names that occur twice or more,
    for their flushes."""
    out, names, places, owners, keys = [], [], [], [], []
    for flush, part, docs in zip(*(group.column(c) for c in ("flush", "part", "docs"))):
        if docs.is_valid:
            out.append((None, flush.as_py(), None, docs.as_py()))
            continue
        raw = part.as_py()
        n = len(raw) // 8
        names.append(np.frombuffer(raw, np.uint32, n))
        places.append(np.frombuffer(raw, np.uint32, n, 4 * n))
        owners.append(np.full(n, len(keys), np.int32))
        keys.append(flush.as_py())
    if names:
        name = np.concatenate(names)
        twice = _twice(name)
        place, owner = np.concatenate(places)[twice], np.concatenate(owners)[twice]
        for k in np.unique(owner):
            out.append((None, keys[k], place[owner == k].tobytes(), None))
    return _table(_NAMES, _TYPES, out)


def _twice(name: np.ndarray) -> np.ndarray:
    """Which names equal another one: neighbours after sorting."""
    order = np.argsort(name, kind="stable")
    same = np.zeros(len(name) + 1, bool)
    same[1:-1] = name[order[1:]] == name[order[:-1]]
    out = np.zeros(len(name), bool)
    out[order] = same[:-1] | same[1:]
    return out


def _candidates(group: pa.Table) -> pa.Table:
    """Documents of one flush, each with the runs of positions that may start
    a repeated string (first and last of each run), if there are any."""
    docs = np.concatenate([np.frombuffer(x.as_py(), _DOC) for x in group.column("docs") if x.is_valid])
    hits = [np.frombuffer(x.as_py(), np.uint32) for x in group.column("part") if x.is_valid]
    place = np.sort(np.concatenate(hits)).astype(np.int64) if hits else np.zeros(0, np.int64)
    runs: list[bytes | None] = [None] * len(docs)
    for k in np.flatnonzero(docs["at"] >= 0):
        at, n = int(docs["at"][k]), int(docs["n"][k])
        a, b = np.searchsorted(place, (at, at + n))
        if b > a:
            sample = place[a:b] - at
            low, high = np.maximum(sample - PERIOD + 1, 0), np.minimum(sample, n - LENGTH)
            new = np.append(True, low[1:] > high[:-1] + 1)
            ends = np.append(high[:-1][new[1:]], high[-1])
            both = np.stack((low[new], ends), 1)
            both = both[both[:, 1] >= both[:, 0]]
            if len(both):
                runs[k] = both.astype("<i8").tobytes()
    void = -(1 << 63)
    return pa.table({"doc_id": pa.array(docs["id"], pa.int64(), mask=docs["id"] == void), "n_bytes": pa.array(docs["n"]),
                     "sha": pa.array([x.tobytes() for x in docs["sha"]], pa.binary()), "runs": pa.array(runs, pa.binary())})


def _key_of(sha: list[bytes], ids: np.ndarray, size: int) -> np.ndarray:
    first = np.array([int.from_bytes(x[:8], "little") for x in sha], U)
    return mix(first ^ mix(ids.view(U))) % U(size)


def _filter_size(n: int) -> int:
    """Bits for n wanted texts: a power of two, so that at most one in
    BITS_A_TEXT is set up to MOST_BITS."""
    return min(max(FILTER_BITS, 1 << (n * BITS_A_TEXT - 1).bit_length()), MOST_BITS) if n else FILTER_BITS


def _filter(wanted: DataFrame) -> np.ndarray:
    """A bit for each key of (sha, doc_id): MOST_BITS of them at most, whatever
    the corpus, so the driver receives a bounded table.  Other rows that pass
    are dropped by the join that follows."""
    size = _filter_size(wanted.count())

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = _key_of(batch.column("sha").to_pylist(), ids_of(batch.column("doc_id")), size).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key >> 6), pa.array(key & 63)], ["word", "bit"])

    words = (wanted.select("sha", "doc_id").mapInArrow(keys, "word long, bit long")
             .groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, cast(bit as int))")).alias("bits")).toPandas())
    out = np.zeros(size >> 6, np.int64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return out.view(U)


def _texts(bits: np.ndarray):
    """Texts that pass the filter, each once a task."""
    size = len(bits) << 6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            ids = ids_of(batch.column("doc_id"))
            long = np.flatnonzero(np.diff(offsets) >= LENGTH)
            sha = [hashlib.sha256(data[offsets[k]:offsets[k + 1]]).digest() for k in long]
            if not sha:
                continue
            key = _key_of(sha, ids[long], size)
            some = []
            for k in np.flatnonzero(bits[(key >> U(6)).astype(np.int64)] >> (key & U(63)) & U(1)):
                if sha[k] not in seen:
                    seen.add(sha[k])
                    some.append(k)
            yield pa.RecordBatch.from_arrays(
                [pa.array([sha[k] for k in some], pa.binary()),
                 pa.array([data[offsets[r]:offsets[r + 1]].tobytes() for r in long[some]], pa.binary())], ["sha", "text"])

    return run


def _chosen(base: DataFrame, wanted: DataFrame) -> DataFrame:
    """sha, text and runs of every wanted text, one row each however many
    copies there are and however many of them pass the filter."""
    texts = base.mapInArrow(_texts(_filter(wanted)), "sha binary, text binary").dropDuplicates(["sha"])
    return texts.join(wanted.select("sha", "runs"), "sha").select("sha", "text", "runs")


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with candidates, several in a row."""
    task = TaskContext.get().partitionId()
    many = pa.list_(pa.binary())
    held, size, n = [], 0, 0

    def unit():
        row = (f"{task}-{n}", [h[0] for h in held], [h[1] for h in held], [h[2] for h in held])
        return _table(["unit", "shas", "texts", "runs"], [pa.string(), many, many, many], [row]).combine_chunks().to_batches()[0]

    for batch in batches:
        for own in zip(*(batch.column(c) for c in ("sha", "text", "runs"))):
            held.append(tuple(x.as_py() for x in own))
            size += len(held[-1][1])
            if size >= UNIT:
                yield unit()
                held.clear()
                size, n = 0, n + 1
    if held:
        yield unit()


def _positions(texts: list[bytes], runs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The joined bytes of a unit, its text bounds and all candidates."""
    bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    each = [np.frombuffer(r, "<i8").reshape(-1, 2) + b for r, b in zip(runs, bounds)]
    low, high = np.concatenate(each).T
    length = high - low + 1
    position = np.repeat(low - np.concatenate(([0], np.cumsum(length)[:-1])), length) + np.arange(length.sum())
    return np.frombuffer(b"".join(texts), np.uint8), bounds, position


def _places(data: np.ndarray, position: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of the ``LENGTH``-byte prefixes at ``position``, and their ranges."""
    a = _FIRST.window(_FIRST.prefix(data), position, position + LENGTH)
    b = mix(_SECOND.window(_SECOND.prefix(data), position, position + LENGTH))
    return mix(a ^ (b << U(1))), (mix(b) >> U(32)) * U(buckets) >> U(32)


def _prefix_names(buckets: int):
    """Step 2, task side: names of all candidates of a unit by range, in the
    order of their positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit, texts, runs in zip(*(batch.column(c) for c in ("unit", "texts", "runs"))):
                data, _, position = _positions(texts.as_py(), runs.as_py())
                name, bucket = _places(data, position, buckets)
                order = np.argsort(bucket.astype(np.uint32), kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=U))
                name = name[order]
                rows = [(b, unit.as_py(), name[cuts[b]:cuts[b + 1]].tobytes()) for b in range(buckets) if cuts[b + 1] > cuts[b]]
                yield from _table(["bucket", "unit", "names"], [pa.int32(), pa.string(), pa.binary()], rows).to_batches()

    return run


def _repeated_prefixes(group: pa.Table) -> pa.Table:
    """Step 2 in a range: for each unit, a bit per name that occurs twice."""
    names = [np.frombuffer(x.as_py(), U) for x in group.column("names")]
    twice = np.split(_twice(np.concatenate(names)), np.cumsum([len(n) for n in names])[:-1])
    rows = [(b.as_py(), u.as_py(), np.packbits(t).tobytes()) for b, u, t in zip(group.column("bucket"), group.column("unit"), twice)]
    return _table(["bucket", "unit", "bits"], [pa.int32(), pa.string(), pa.binary()], rows)


def _spans(buckets: int):
    """Step 3: the removed spans of each text of a unit."""

    def run(units: pa.Table, replies: pa.Table) -> pa.Table:
        out = []
        bits = dict(zip(replies.column("bucket").to_pylist(), replies.column("bits").to_pylist()))
        for shas, texts, runs in zip(*(units.column(c).to_pylist() for c in ("shas", "texts", "runs"))):
            data, bounds, position = _positions(texts, runs)
            bucket = _places(data, position, buckets)[1]
            order = np.argsort(bucket.astype(np.uint32), kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=U))
            twice = np.zeros(len(position), bool)
            for b, packed in bits.items():
                own = order[cuts[b]:cuts[b + 1]]
                twice[own] = np.unpackbits(np.frombuffer(packed, np.uint8))[:len(own)].astype(bool)
            start = position[twice]
            for k, text in enumerate(texts):
                a, b = np.searchsorted(start, (bounds[k], bounds[k + 1]))
                own = start[a:b] - bounds[k]
                new = np.append(True, own[1:] > own[:-1] + LENGTH)[:len(own)]
                low = own[new]
                high = np.append(own[:-1][new[1:]], own[-1:]) + LENGTH
                cut = np.stack((low, high), 1).ravel()
                kept = hashlib.sha256()
                for x, y in zip([0, *cut[1::2]], [*cut[::2], len(text)]):
                    kept.update(text[x:y])
                out.append((shas[k], int((high - low).sum()), len(low), kept.hexdigest(), cut.tolist()))
        return _table(["sha", "n_removed", "n_spans", "kept_sha256", "spans"],
                      [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())], out)

    return run


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and ``spans`` (byte
    starts and ends of what is removed, flat) of every row."""
    buckets = bucket_count(docs)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    hits = base.mapInArrow(_deal(buckets), _SQL).groupBy("bucket").applyInArrow(_repeated_samples, _SQL)
    rows = store(hits.groupBy("flush").applyInArrow(_candidates, "doc_id long, n_bytes long, sha binary, runs binary"), "rows")

    # one row of each text that has candidates
    wanted = store(rows.where("runs IS NOT NULL").groupBy("sha").agg(F.min("doc_id").alias("doc_id"), F.first("runs").alias("runs")), "wanted")
    units = store(_chosen(base, wanted).mapInArrow(
        _units, "unit string, shas array<binary>, texts array<binary>, runs array<binary>"), "units")
    ranges = bucket_count(units, 1 << 20)
    replies = (units.mapInArrow(_prefix_names(ranges), "bucket int, unit string, names binary")
               .groupBy("bucket").applyInArrow(_repeated_prefixes, "bucket int, unit string, bits binary"))
    found = units.groupBy("unit").cogroup(replies.groupBy("unit")).applyInArrow(
        _spans(ranges), "sha binary, n_removed long, n_spans long, kept_sha256 string, spans array<long>")

    copies = rows.groupBy("sha").agg(F.count(F.lit(1)).alias("copies"), F.first("n_bytes").alias("n")).where("copies > 1").where(f"n >= {LENGTH}")
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    whole = copies.select("sha", F.col("n").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), nothing.alias("kept_sha256"),
                          F.array(F.lit(0).cast("long"), "n").alias("spans"), F.lit(1).alias("first"))
    cut = store(whole.union(found.withColumn("first", F.lit(0))).groupBy("sha")
                .agg(F.max_by(F.struct("n_removed", "n_spans", "kept_sha256", "spans"), "first").alias("c")).where("c.n_removed > 0"), "cut")
    out = rows.select("doc_id", "n_bytes", "sha").join(cut, "sha", "left")
    return out.select(
        "doc_id", "n_bytes", F.coalesce("c.n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("c.n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("c.kept_sha256", F.lower(F.hex("sha"))).alias("kept_sha256"),
        F.coalesce("c.spans", F.array().cast("array<long>")).alias("spans"))
