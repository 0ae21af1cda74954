"""op5 against brute force on whole given tables, row by row, and how long the
passages are that its documents share.

usage: python -m tests.llm.brute_substrings [table folder]   (default: check_s)

Every 400-byte window of every text is hashed, by nested steps that share nothing
with op5's names, and sorted in ranges of hashes; neighbours of one hash are
compared byte by byte, and a window that occurs twice covers its bytes.  Needs
some 9 bytes of scratch disk for each byte of text.
"""

import hashlib
import sys
import tempfile
from collections import Counter
from multiprocessing import get_context

import numpy as np
import pyarrow.dataset as ds

from quarry.llm import substrings
from quarry.llm.common import Rolling, mix, table

LENGTH = 400
U = np.uint64
BLOCK, RANGES = 1 << 20, 16


def scramble(x: np.ndarray) -> np.ndarray:
    x ^= x >> U(31)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(29)
    return x


def window_keys(data: np.ndarray) -> np.ndarray:
    """A hash of each window of LENGTH bytes, from those of 256, 128 and 16."""
    def beside(a, b, gap):
        n = len(b) - gap
        return scramble(a[:n] * U(0xD6E8FEB86659FD93) + b[gap:])

    sizes = {1: scramble(data.astype(U) * U(0x9E3779B97F4A7C15) + U(77))}
    for k in (1, 2, 4, 8, 16, 32, 64, 128):
        sizes[2 * k] = beside(sizes[k], sizes[k], k)
    return beside(beside(sizes[256], sizes[128], 256), sizes[16], 384)


def _hash_block(block: tuple[int, int]) -> None:
    a, b = block
    if b - a >= LENGTH:
        own = window_keys(joined[a:b])
        keys[a:a + len(own)] = own


def _mark_range(r: int) -> int:
    """Marks the windows of a range of hashes that occur twice; pairs compared."""
    some, at = [], []
    for a in range(0, len(keys), BLOCK):
        own = keys[a:a + BLOCK]
        hits = np.flatnonzero((own >> U(32)) * U(RANGES) >> U(32) == U(r))
        hits = hits[inside[a + hits]]
        some.append(own[hits])
        at.append(a + hits)
    key, place = np.concatenate(some), np.concatenate(at)
    order = np.argsort(key)
    key, place = key[order], place[order]
    same = np.flatnonzero(key[1:] == key[:-1])
    windows = np.lib.stride_tricks.sliding_window_view(joined, LENGTH) if len(same) else None
    for i in range(0, len(same), 1 << 14):
        p, q = place[same[i:i + (1 << 14)]], place[same[i:i + (1 << 14)] + 1]
        assert (windows[p] == windows[q]).all(), "different windows of one hash"
        repeated[p] = repeated[q] = True
    return len(same)


def expected(texts: list[bytes]) -> list[tuple[int, int, int, str]]:
    """(n_bytes, n_removed, n_spans, kept_sha256) of each text."""
    global joined, keys, inside, repeated  # the forked tasks share them
    joined = np.frombuffer(b"".join(texts), np.uint8)
    bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
    size, scratch = max(1, len(joined)), tempfile.mkdtemp(prefix="run-", dir="/tmp")
    keys = np.memmap(f"{scratch}/keys", U, "w+", shape=(size,))
    repeated = np.memmap(f"{scratch}/repeated", bool, "w+", shape=(size,))
    inside = np.zeros(size, bool)
    for a, b in zip(bounds[:-1], bounds[1:]):
        inside[a:max(a, b - LENGTH + 1)] = True
    cuts = bounds[np.unique(np.searchsorted(bounds, np.arange(0, len(joined) + BLOCK, BLOCK)).clip(0, len(texts)))]
    with get_context("fork").Pool(4) as pool:
        pool.map(_hash_block, list(zip(cuts[:-1], cuts[1:])))
        pairs = sum(pool.map(_mark_range, range(RANGES), chunksize=1))
    print(f"{pairs} pairs of neighbours equal byte by byte", flush=True)
    out = []
    for k, t in enumerate(texts):
        hits = np.flatnonzero(repeated[bounds[k]:bounds[k + 1]])
        steps = np.zeros(len(t) + 1, np.int64)
        np.add.at(steps, hits, 1)
        np.add.at(steps, hits + LENGTH, -1)
        gone = np.cumsum(steps[:-1]) > 0
        spans = int((np.diff(np.concatenate(([0], gone.astype(np.int8)))) == 1).sum())
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def shared_passages(texts: list[bytes], words: int = 51) -> np.ndarray:
    """For each of these different texts the bytes of its longest run of windows of
    so many words that other texts have too (0 if none): it shares no longer passage."""
    rolling, hashes, owners, starts, ends = Rolling(0x9E3779B97F4A7C15), [], [], [], []
    for k, t in enumerate(texts):
        data = np.frombuffer(t, np.uint8)
        gap = np.concatenate(([True], (data == 32) | ((data >= 9) & (data <= 13)), [True]))
        start, end = np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])
        start, end = start[:max(0, len(start) - words + 1)], end[words - 1:]
        hashes.append(mix(rolling.window(rolling.prefix(data), start, end)))
        owners.append(np.full(len(start), k))
        starts.append(start)
        ends.append(end)
    name, owner, start, end = (np.concatenate(x) for x in (hashes, owners, starts, ends))
    best = np.zeros(len(texts), np.int64)
    if not len(name):
        return best
    order = np.argsort(name)
    new = np.append(True, name[order[1:]] != name[order[:-1]])
    first = np.flatnonzero(new)
    across = np.minimum.reduceat(owner[order], first) != np.maximum.reduceat(owner[order], first)
    shared = np.zeros(len(name), bool)
    shared[order] = across[np.cumsum(new) - 1]
    at = np.flatnonzero(shared)
    if len(at):
        run = np.flatnonzero(np.append(True, (np.diff(at) > 1) | (np.diff(owner[at]) > 0)))
        np.maximum.at(best, owner[at[run]], end[at[np.append(run[1:], len(at)) - 1]] - start[at[run]])
    return best


def main() -> None:
    from quarry.session import build_session
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/check_s"
    spark = build_session()
    got = substrings.dedup(table(spark, folder, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    spark.stop()
    docs = ds.dataset(f"{folder}/documents.parquet").to_table(columns=["doc_id", "text"])
    ids, texts = docs["doc_id"].to_pylist(), [(t or "").encode() for t in docs["text"].to_pylist()]
    marks = [t.encode() for t in ds.dataset(f"{folder}/benchmark.parquet").to_table()["text"].to_pylist() if t and len(t.split()) > 50]
    want = expected(texts)
    bad = Counter((i, *w) for i, w in zip(ids, want)) - Counter(tuple(r) for r in got)
    print(f"{len(ids)} rows, {len(got)} in the result, {bad.total()} differ from brute force; {sum(w[1] > 0 for w in want)} have a repeated string of {LENGTH} bytes")

    different = list(dict.fromkeys(texts))
    removed = dict(zip(texts, (w[1] for w in want)))
    cut = np.array([removed[t] > 0 for t in different])
    shared = shared_passages(different)
    for label, some in (("without a shared passage of over 50 words", shared == 0), (f"with one, all under {LENGTH} bytes", (shared > 0) & (shared < LENGTH)),
                        (f"with one in a run of {LENGTH} bytes or more", shared >= LENGTH)):
        print(f"different texts {label}: {some.sum()}, with bytes removed: {(cut & some).sum()}")
    has = np.array([any(m in t for m in marks) for t in texts])
    size, gone = np.array([w[0] for w in want]), np.array([w[1] > 0 for w in want])
    print(f"{len(marks)} benchmark texts have over 50 words; the longest has {max(map(len, marks), default=0)} bytes")
    if has.any() and not has.all():
        middle = np.median(size[~has])
        print(f"rows that hold one: {has.sum()}; bytes removed in {(has & gone).sum()}; n_bytes above the others' median ({middle:.0f}) in "
              f"{(size[has] > middle).mean():.2f} of them and not above it in {(size[~has] <= middle).mean():.2f} of the others")


if __name__ == "__main__":
    main()
