"""Filter audit, vector packing and the conversation trie against brute force,
on nulls, empty and long texts, ties, repeated rows, empty tables and clashing
column names."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from quarry.llm import filter_audit, prefix_trie, vector_packing, vocabulary
from quarry.llm.vector_packing import Limits, Packer, Piece


# ------------------------------------------------------------- filter audit
def audit_rows():
    rng = random.Random(3)
    vocab = ["".join(rng.choices("abcXYZ", k=rng.randint(1, 6))) for _ in range(300)]
    texts = [None, "", "short one", "A" * 80, "a|b " * 70, " ".join(rng.choices(vocab, k=90)).lower(),
             " ".join(rng.choices(vocab, k=4000)), "\x0b\x0c \x85 " * 30, "é" * 300, "word " * 60]
    texts += [" ".join(rng.choices(vocab, k=rng.randint(30, 120))) + rng.choice(["", " #", " $%"]) for _ in range(40)]
    rows = [(k, t, rng.choice(["p", "q", None, ""]), 7) for k, t in enumerate(texts)]
    rows += [(k + 100, rng.choice(texts), "p", 7) for k in range(40)]
    return rows + [rows[5], rows[5], (5, rows[5][1], "q", 7), (None, rows[6][1], "p", 7), (None, "only without id", "q", 7), (None, "only without id", "q", 7)]


def audit_brute(rows, labels):
    first, good, toxic = {}, set(), set()
    for k, t, *_ in rows:
        if k is not None:
            first[t or ""] = min(k, first.get(t or "", k))
    for k, q, x in labels:
        good |= {k} if q == 1 else set()
        toxic |= {k} if x == 1 else set()
    docs = defaultdict(list)
    for k, t, s, _ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
                 "D": bool(re.search(r"[#$%&*|]", t)), "E": t in first and (k is None or first[t] < k)}
        docs[s or ""].append(({f for f, x in fails.items() if x}, k in good and k is not None, k in toxic and k is not None))
    out = []
    for part, held in docs.items():
        rows_, shapley = [], defaultdict(int)
        for order in itertools.permutations("ABCDE"):
            left = list(held)
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                earlier = sum(f in d[0] for d in held) - len(gone)
                left = [d for d in left if f not in d[0]]
                shapley[f] += len(gone)
                rows_.append((part, "".join(order), step, len(left), len(gone), earlier, sum(d[0] == {f} for d in held),
                              sum(d[1] for d in gone), sum(d[2] for d in gone), f))
        out += [(*r[:-1], shapley[r[-1]]) for r in rows_]
    return sorted(out)


def test_filter_audit(spark):
    rows = audit_rows()
    labels = [(k, k % 2, int(k % 3 == 0)) for k in range(0, 140, 2)] + [(4, 1, 1), (4, 0, None), (7, None, 1), (None, 1, 1), (9999, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n int").withColumnRenamed("n", "bits")
    labelled = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(filter_audit.failures(docs.repartition(4), labelled))
    assert sorted(map(tuple, got.collect())) == audit_brute(rows, labels)


def test_filter_audit_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(filter_audit.failures(docs, labels)).count() == 0


# ------------------------------------------------------------ vector packing
def packing_texts():
    rng = random.Random(8)
    vocab = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) for _ in range(500)]
    long = lambda n: " ".join(rng.choices(vocab, k=n))
    return [None, "", " \n\t ", "One 'S it's WE'LL 1234!", "É é İ ΑΣ ς ß ﬁ 漢字 x\u0085y z", "a <|endoftext|> b<|startoftext|>",
            "x" * 30_000, long(9000), "\x1c\x1d a\x0bb\x0cc\r\nd", "🙂🙂 ok", " ".join(["..."] * 50)] + [long(rng.randint(1, 900)) for _ in range(150)] + [""] * 60


def test_vector_packing(spark):
    from tokenizers import Tokenizer
    texts = packing_texts()
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, "no id")]
    docs = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, start int").repartition(3)
    got = vector_packing.pack(docs, with_ids=True, pool=1 << 14).collect()
    library = Tokenizer.from_file(vocabulary.path("word_bpe_49k.json"))
    expected = {(k, t): library.encode(t or "", add_special_tokens=False).ids + [2] for k, t in rows}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] > 0 and r["ids_crc32"] == zlib.crc32(r["ids"])
        pieces[r["doc_id"]].append((r["start"], ids, r["doc_tokens"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc_id in {k for k, _ in rows}:
        whole = [ids for (k, _), ids in expected.items() if k == doc_id]
        copies = sum(k == doc_id for k, _ in rows)
        assert sum(len(ids) for _, ids, _ in pieces[doc_id]) == len(whole[0]) * copies
        for start, ids, n in pieces[doc_id]:
            assert any(w[start:start + len(ids)] == ids and len(w) == n for w in whole)
    padding = 0
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    assert padding == 0
    total = sum(map(len, (expected[r] for r in rows)))
    assert len(sequences) <= -(-total // 4096) + 3 * 12  # each of three tasks ends in at most twelve short ones


def test_vector_packing_of_nothing(spark):
    assert vector_packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_packer_keeps_every_limit_and_every_token():
    rng = random.Random(1)
    limits = Limits(512, 9, 300)
    packer = Packer(limits, cut=False)
    items = [(n := rng.randint(1, 512), rng.randint(0, min(n, 300))) for _ in range(3000)]
    for k, (n, loss) in enumerate(items):
        packer.add(Piece(k, 0, n, loss))
    made = list(packer.sequences())
    assert sorted(p.item for s in made for p in s) == list(range(3000))
    for s in made:
        assert sum(p.length for p in s) <= 512 and len(s) <= 9 and sum(p.loss for p in s) <= 300
    least = max(sum(n for n, _ in items) / 512, 3000 / 9, sum(x for _, x in items) / 300)
    assert len(made) <= 1.1 * least

    packer = Packer(Limits(512, 4, 512))
    for k, (n, _) in enumerate(items):
        packer.add(Piece(k, 0, n, n))
    made = list(packer.sequences())
    for s in made:
        size = sum(p.length for p in s)
        assert len(s) <= 4 and size & (size - 1) == 0
    cover = defaultdict(list)
    for s in made:
        for p in s:
            cover[p.item].append((p.start, p.start + p.length))
    for k, (n, _) in enumerate(items):
        spans = sorted(cover[k])
        assert spans[0][0] == 0 and spans[-1][1] == n and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_examples_are_not_cut(spark):
    conversations = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    examples = vector_packing.conversation_examples(conversations).cache()
    assert examples.where("loss <= 0 OR loss >= tokens").count() < examples.count()
    extra = spark.createDataFrame([(-1, 5000, 10), (-2, None, None), (-3, 4096, 4096), (-3, 4096, 4096)], "id long, tokens long, loss long")
    rows = examples.union(extra)
    got = vector_packing.pack_examples(rows.repartition(2), Limits(4096, 6, 1500)).collect()
    assert sorted((r["id"], r["tokens"], r["loss"]) for r in got) == sorted((r[0], r[1] or 0, r[2] or 0) for r in rows.collect())
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append(r)
    for held in sequences.values():
        if any(r["oversize"] for r in held):
            assert len(held) == 1 and (held[0]["tokens"] > 4096 or held[0]["loss"] > 1500)
            continue
        assert sum(r["tokens"] for r in held) <= 4096 and len(held) <= 6 and sum(r["loss"] for r in held) <= 1500


# ---------------------------------------------------------- conversation trie
def conversations_rows():
    rng = random.Random(4)
    said = ["hi", "", None, "é漢", "what is it", "1"]
    rows = []
    for c in [*range(0, 23), 26, 27, 40, 44, -3, -5, -7, 1000, 1004]:
        for turn in range(rng.randint(1, 12)):
            rows.append((c, turn, rng.choice(["user", "assistant", None, ""]) if turn > 1 else "user", said[0] if turn == 0 else rng.choice(said), 1))
    for c in (50, 51, 52):  # long ones that part late
        rows += [(c, t, "user", f"turn {t if t < 60 else t * c}", 1) for t in range(70)]
    for c in range(2000, 2040, 5):  # copies
        rows += [(c, t, "user", "same", 1) for t in range(5)]
    rows += [(6, None, "system", "first of all", 1), (6, 3, "user", "tie", 1), (6, 3, "user", "tie", 1), (None, 0, "user", "nobody's", 1)]
    return rows


def trie_brute(rows):
    tid = lambda role, text: hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest()
    own = defaultdict(list)
    for c, turn, role, text, _ in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), tid(role, text)[:32], role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    paths = {}
    for c in own:
        base = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = defaultdict(set)
    for node in members:
        if node:
            children[node[:-1]].add(node)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, held in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(held) - 1) * len(node[-1][1].encode()) if node else 0
    return sorted(((min(m), len(x), min(members[x[:-1]]) if x else None, len(m), len(children[x]), leaves[x], saved[x],
                    hashlib.sha256(",".join(str(c) for c in sorted(m) if len(paths[c]) == len(x)).encode()).hexdigest())
                   for x, m in members.items()), key=repr)


@pytest.mark.parametrize("chunk", [prefix_trie.CHUNK, 2])
def test_prefix_trie(spark, monkeypatch, chunk):
    monkeypatch.setattr(prefix_trie, "CHUNK", chunk)
    rows = conversations_rows()
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n int").withColumnRenamed("n", "depth")
    got = sorted(map(tuple, prefix_trie.trie(table.repartition(5)).collect()), key=repr)
    assert got == trie_brute(rows)


def test_prefix_trie_of_nothing(spark):
    table = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.trie(table).count() == 0
