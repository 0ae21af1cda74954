"""The text-preparation operators against brute force, on small fixtures that
hold nulls, empty and long texts, ties, repeated rows and clashing names."""

import base64
import bisect
import hashlib
import random
import re
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import bpe, components, dac, exact, html, jaccard, licenses, packing, quality, secrets, substrings, vocabulary

WHITE = "\x20\x09\x0a\x0b\x0c\x0d"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def fixture_texts():
    rng = random.Random(5)
    vocab = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 7))) for _ in range(400)]
    long = lambda n: " ".join(rng.choices(vocab, k=n))
    base, other = long(150), long(90)
    near = base.split()
    near[40] = "changed"
    passage = long(120)
    texts = [None, "", " \n\t ", "one", "One TWO", "one two", base, base, base.replace(" ", "\n", 3) + " ", " ".join(near),
             other, other.upper(), long(30) + " " + passage + " " + long(20), long(25) + "\n" + passage, "ab " * 300,
             "\n".join(["same line here"] * 30 + ["x y z"]), "é ü 漢字 " * 40, "  two  spaces\n\nand lines \n ", "\x01 odd \x01",
             long(6000), "### $$$ " * 30, "SHOUT!! LOUD!! " * 20, "tail\n", "<|endoftext|> it's we're 12345 a b\r\n"]
    return texts + [long(rng.randint(1, 80)) for _ in range(30)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "x", True, 1) for k, t in enumerate(fixture_texts())] + [(0, None, "x", False, 2), (6, fixture_texts()[6], "y", None, 3)]
    schema = "doc_id long, text string, n_words string, kept boolean, part int"
    return spark.createDataFrame(rows, schema).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, length int")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_quality_ledger(docs, empty):
    got = by_id(quality.apply_policy(quality.ledger(docs)))
    for k, t in enumerate(fixture_texts()):
        w, t = words(t), t or ""
        seen = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if seen[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in t.split("\n") if words(x)]
        r = got[k]
        assert r["n_words"] == len(w) and r["n_repeat_words"] == len(covered)
        assert r["word_chars"] == sum(map(len, w)) and r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", t))
        assert r["base_failed"] == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
        assert not (r["base_failed"] and r["kept"])
    assert quality.keep_good(docs).columns == docs.columns
    assert quality.ledger(empty).count() == 0
    bits = [r["failed_bits"] for r in quality.ledger(docs).collect()]
    for r in quality.ablations(quality.ledger(docs)).collect():
        bit = 1 << quality.RULES.index(r["rule"])
        assert (r["n_failed"], r["n_only"], r["n_documents"]) == (sum(b & bit > 0 for b in bits), bits.count(bit), len(bits))


def test_byte_bpe_equals_tiktoken(docs, empty):
    import tiktoken
    path = vocabulary.path(vocabulary.MULTI_RANKS)
    ranks = {t: i for i, t in enumerate(bpe.read_ranks(path))}
    own = tiktoken.Encoding("own", pat_str=vocabulary.pattern(), mergeable_ranks=ranks, special_tokens={})
    got = by_id(bpe.encode(docs))
    for k, t in enumerate(fixture_texts()):
        ids = np.array(own.encode_ordinary(t or ""), "<u4").tobytes()
        assert got[k]["ids"] == ids and got[k]["n_tokens"] == len(ids) // 4
        assert got[k]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode(empty).count() == 0


def library_ids(texts):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(vocabulary.path(vocabulary.BYTE_BPE))
    tokenizer.encode_special_tokens = True
    return [np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4") for t in texts]


def test_packing(docs, empty):
    ids = library_ids(fixture_texts())
    rows = packing.pack(docs).collect()
    bins, of = defaultdict(list), defaultdict(set)
    for r in rows:
        own = ids[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        assert len(own) == r["length"] <= 2048 and zlib.crc32(own.tobytes()) == r["ids_crc32"]
        assert r["piece"] == 0 or r["length"] == 2048
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        of[r["doc_id"]].add((r["start"], r["length"]))
    for k, own in enumerate(ids):
        assert sum(n for _, n in of[k]) == len(own)
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    plain = []
    for n in sorted((r["length"] for r in rows), reverse=True):
        at = bisect.bisect_left(plain, n)
        bisect.insort(plain, (plain.pop(at) if at < len(plain) else 2048) - n)
    assert len(bins) == len(plain)
    assert packing.pack(empty).count() == 0
    assert "ids" in packing.pack(docs, with_ids=True).columns


def test_capacity_tree():
    rng, tree, open_ = random.Random(1), packing.CapacityTree(50), Counter()
    for _ in range(500):
        c = rng.randint(0, 50)
        n = 1 if not open_[c] or rng.random() < 0.5 else -open_[c]
        open_[c] += n
        tree.add(c, n)
        least = rng.randint(0, 50)
        assert tree.tightest(least) == min((x for x in open_ if open_[x] and x >= least), default=None)


def test_token_files(docs, empty):
    ids = library_ids(fixture_texts())
    rows = sorted((r for r in dac.round_trip(docs).collect()), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == sorted(r["doc_id"] for r in rows)
    at = 0
    for r in rows:
        own = ids[r["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(own), zlib.crc32(own.tobytes()))
        at += len(own)
    assert dac.round_trip(empty).count() == 0


def test_added_tokens(spark, tmp_path):
    """The registered queries give the library's ids as it is loaded."""
    from tokenizers import Tokenizer

    from quarry.llm import queries

    end = "<|endoftext|>"
    texts = [*fixture_texts(), f"a {end} b", end * 3, f"  {end}  x\n{end}\n\n'tis", f"it{end}'s <|endoftext", f"\x01 {end}", "word " * 3000 + end + " tail"]
    tokenizer = Tokenizer.from_file(vocabulary.path(vocabulary.BYTE_BPE))
    own = [np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4") for t in texts]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    at = 0
    rows = sorted(queries.op10_token_output(spark, str(tmp_path)).collect(), key=lambda r: r["doc_id"])
    for r, ids in zip(rows, own, strict=True):
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    got = Counter()
    for r in queries.op3_best_fit_packing(spark, str(tmp_path)).collect():
        assert r["ids_crc32"] == zlib.crc32(own[r["doc_id"]][r["start"]:r["start"] + r["length"]].tobytes())
        got[r["doc_id"]] += r["length"]
    assert got == {k: len(ids) for k, ids in enumerate(own)}


def test_direct_codes():
    rng = np.random.default_rng(0)
    for top in (1, 200, 50_000, 1 << 31):
        ids = rng.integers(0, top, 5000).astype(np.uint32)
        codes = dac.DirectCodes.load(dac.DirectCodes.build(ids).dump())
        at = rng.integers(0, 5000, 900)
        assert (codes.get(at) == ids[at]).all() and (codes.get(np.arange(5000)) == ids).all()


def test_page_labeller_held_out(spark):
    model = html.trained()
    rng, pages, blocks, right = np.random.default_rng(1234), 0, 0, 0
    for _ in range(80):
        page, labels = html.example(rng)
        got = html.label(model, [html.blocks(page)])[0]
        blocks += len(labels)
        right += int((got == np.array(labels)).sum())
    assert right / blocks > 0.99
    deep = "<div>" * 3000 + "x"
    rows = [(1, "u", None), (2, "u", ""), (3, None, "<nav><a>menu</a></nav><article><p>A &amp;  b\n c<p>d</article>"), (None, "u", deep), (3, None, "plain")]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), model).collect()
    assert len(got) == 5
    assert [r["text"] for r in got[:3]] == ["", "", "A & b c\nd"]
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def test_page_drops_nothing_else():
    """Hand-made pages with embedded elements, which the generator does not draw."""
    texts = lambda page: [b[0] for b in html.blocks(page)]
    after = "<article><p>one</p><p>two</p></article>"
    for tag in ("<svg/>", '<svg viewBox="0 0 1 1"/>', "<svg hidden />", "<math/>", '<object data="x"/>', '<script src="x"/>', "<iframe src=x>", "<svg>", "<svg><path d=x>",
                "<math><mi>", "<object data=x>", "<noscript>", "<template>", "<img src=/a/>", "<video src=x>", "<p><svg><g></p>"):
        assert texts(tag + after) == ["one", "two"], tag
        assert texts(tag + after + "<svg><path/></svg><p>three</p>") == ["one", "two", "three"], tag
    for tag in ("img", "input", "embed", "svg/", "object data=x></object", "iframe>gone</iframe", "svg><path d=x /></svg", "picture><source><img></picture"):
        assert texts(f"<p>a <{tag}> b</p><p>c</p>") == ["a b", "c"], tag
    assert texts("<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p>") == ["so x = 1 holds"]
    assert texts("<p>a <svg><title>t</title><style>s</style><text>u</text></svg> b</p>") == ["a t u b"]
    assert texts("<p>a <object>b</object> <noscript>c</noscript></p>") == ["a b c"]
    assert texts("<noscript><p>a</p><p>b</p></noscript>") == ["a", "b"]
    assert texts("<svg><foreignObject><p>a</p><p>b</p></foreignObject></svg>c") == ["a", "b", "c"]
    assert texts("<p>x</p><textarea>1 < 2 <p>y</textarea><p>z</p>") == ["x", "1 < 2 <p>y", "z"]
    assert texts("a<script>x</script><style>y</style><!-- z -->") == ["a"]
    model = html.trained()
    plain = "<html><body><nav><ul><li><a href=x>home</a></li></ul></nav><article><h1>Some head</h1><p>Words of the text that stay here.</p>{}<p>More words of the text.</p></article></body></html>"
    want = html.main_text(model, [plain.format("")])[0]
    got = html.main_text(model, [plain.format(x) for x in ("<svg/>", "<svg>", "<object data=x>", "<p><img></p>", "<noscript><p>Also this one here.</p></noscript>")])
    assert got == [want] * 4 + [want.replace("\nMore", "\nAlso this one here.\nMore")]


ARTICLE_PARTS = {
    "th": ("<table><tr><th>Name</th><th>Length</th></tr><tr><td>Otter</td><td>1 m</td></tr></table>", ["Name", "Length", "Otter", "1 m"]),
    "caption": ("<table><caption>Animals by length</caption><tr><td>Otter</td><td>1 m</td></tr></table>", ["Animals by length", "Otter", "1 m"]),
    "figcaption": ('<figure><img src="o.png"><figcaption>An otter in the river</figcaption></figure>', ["An otter in the river"]),
    "div": ("<div>This paragraph stands in a plain division of the article.</div>", ["This paragraph stands in a plain division of the article."]),
    "dl": ("<dl><dt>Otter</dt><dd>A small animal that swims.</dd></dl>", ["Otter", "A small animal that swims."]),
    "ol": ("<ol><li>First do this.</li><li>Then do that.</li></ol>", ["First do this.", "Then do that."]),
    "h3": ("<h3>Smaller head</h3>", ["Smaller head"]),
    "section": ("<section><h2>Part</h2><p>Words of this part.</p></section>", ["Part", "Words of this part."]),
    "details": ("<details><summary>More</summary><p>What was hidden at first.</p></details>", ["More", "What was hidden at first."]),
    "pre": ("<pre>x = 1\ny = 2</pre>", ["x = 1 y = 2"]),
    "blockquote": ("<blockquote>Somebody said this once.</blockquote>", ["Somebody said this once."]),
}


@pytest.mark.parametrize("part", ARTICLE_PARTS)
def test_page_labeller_keeps_every_part_of_an_article(part):
    """Hand-made pages; the pages of training are drawn by ``example``."""
    markup, texts = ARTICLE_PARTS[part]
    model = html.trained()
    for outer in ("article", "main", 'div class="content"'):
        page = ("<html><head><title>Otters</title></head><body><header>River News</header><nav><ul><li><a href=/>Home</a><li><a href=/n>News</a></ul></nav>"
                f"<{outer}><h1>Otters are back</h1><p>They were seen near the old mill on Monday.</p><p>Nobody knows where they came from.</p>{markup}"
                f"<p>The town wants to protect them.</p></{outer.split()[0]}><aside>Read next: bears</aside><div id=comments><div class=comment><p>So nice!</p></div></div>"
                "<footer>&copy; River News</footer></body></html>")
        assert html.main_text(model, [page])[0].split("\n") == [
            "Otters are back", "They were seen near the old mill on Monday.", "Nobody knows where they came from.", *texts, "The town wants to protect them."], outer


def test_blocks_are_found_in_linear_time():
    import time
    for page in ("<a " * 350_000, "x < y <z " * 110_000, "<b>" * 150_000 + "<p></p>" * 50_000, '<a ">" ' * 140_000, "<iframe>" * 110_000,
                 "<li><p>x" * 100_000, "<td><p>x<tr>" * 60_000, "<svg>" * 150_000 + "<p>" * 9, "<!-- " * 200_000):
        t0 = time.process_time()
        html.blocks(page)
        assert time.process_time() - t0 < 12, page[:12]  # about 1 MB each
    assert [b[0] for b in html.blocks("&#" + "1" * 6000 + "; ok")][0].endswith("ok")


def test_page_labeller_on_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    from html import unescape
    for r in html.extract(pages.join(pages.select("page_id", "html").withColumnRenamed("html", "h"), "page_id").drop("h")).join(
            pages.select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = [" ".join(unescape(re.sub(r"</?b>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:h1|p)>", inner)]
        assert r["text"] == "\n".join(p for p in parts if p)


def test_difference_cover():
    for r in (1, 2, 3):
        v, cover = substrings.difference_cover(r)
        assert {(a - b) % v for a in cover for b in cover} == set(range(v))


def test_substrings(docs, empty):
    texts = [t or "" for t in fixture_texts()]
    raw = [t.encode() for t in texts] + [b"", texts[6].encode()]
    n = substrings.LENGTH
    seen = Counter(b[p:p + n] for b in raw for p in range(len(b) - n + 1))
    rows = substrings.dedup(docs).collect()
    assert len(rows) == len(raw)
    removed = 0
    for r in rows:
        b = raw[r["doc_id"]]
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - n + 1):
            if seen[b[p:p + n]] > 1:
                gone[p:p + n] = True
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(b), gone.sum(), runs, hashlib.sha256(kept).hexdigest())
        removed += int(gone.sum())
    assert removed > 0
    assert substrings.dedup(empty).count() == 0


def test_planted_passages(spark):
    """Passages of over 50 words in two documents go if they have 400 bytes; one
    of 399 stays, and so do documents that share none."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices(string.ascii_lowercase, k=rng.randint(4, 6)))
    own = lambda: " ".join(word() for _ in range(rng.randint(40, 400)))
    sizes = [400, 399, 401, 394, 580, 581, 762, 350] * 5
    texts, want = [], []
    for size in sizes:
        passage = " ".join(word() for _ in range(size))[:size].strip().ljust(size, "x")
        assert len(passage.split()) > 50
        texts += [f"{own()} ({passage}) {own()}", f"{own()} [{passage}] {own()}"]
        want += [(size, 1) if size >= 400 else (0, 0)] * 2
    texts += [own() for _ in range(80)]
    want += [(0, 0)] * 80
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    got = by_id(substrings.dedup(docs))
    assert [(got[k]["n_removed"], got[k]["n_spans"]) for k in range(len(texts))] == want
    for k, t in enumerate(texts):
        cut = got[k]["spans"] or [0, 0]
        kept = t[:cut[0]] + t[cut[1]:]
        assert (got[k]["n_bytes"], got[k]["kept_sha256"]) == (len(t), hashlib.sha256(kept.encode()).hexdigest())


def test_copies_move_once(spark):
    """A wanted text is chosen once, whatever passes the filter."""
    import pyarrow as pa

    texts = ["copied " * 100, "other " * 100, "third " * 100]
    shas = [hashlib.sha256(t.encode()).digest() for t in texts]
    rows = [(7, texts[0])] * 300 + [(k, texts[1]) for k in range(300)] + [(k, texts[2]) for k in range(300)]
    base = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    wanted = spark.createDataFrame([(shas[0], 7, b"a"), (shas[1], 0, b"b")], "sha binary, doc_id long, runs binary")
    got = [(bytes(r["sha"]), bytes(r["text"]).decode(), bytes(r["runs"])) for r in substrings._chosen(base, wanted).collect()]
    assert sorted(got) == sorted([(shas[0], texts[0], b"a"), (shas[1], texts[1], b"b")])
    full = np.full(16, 2**64 - 1, np.uint64)
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([k for k, _ in rows], pa.int64()), "text": [t for _, t in rows]})
    passed = [x for out in substrings._texts(full)(iter([batch, batch])) for x in out.column("sha").to_pylist()]
    assert sorted(passed) == sorted(shas)
    assert substrings._filter_size(0) == substrings._filter_size(1000) == 1 << 23
    for n in (1 << 19, 1_000_000, 6_000_000):
        assert n * 16 <= substrings._filter_size(n) < n * 32 + 1
    assert substrings._filter_size(10**9) == substrings.MOST_BITS


def components_by_force(rows):
    sets = []
    for _, t in rows:
        w = words("".join(c.lower() if c.isascii() else c for c in t or ""))
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * k >= 75 * (len(sets[i]) + len(sets[j]) - k):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("cell", [512, 3])
def test_jaccard(docs, empty, monkeypatch, cell):
    monkeypatch.setattr(jaccard, "CELL", cell)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(tuple(r) for r in jaccard.join(docs).collect()) == components_by_force(rows)
    if cell > 3:
        assert jaccard.join(empty).count() == 0
        assert jaccard.keep_one(docs).columns == docs.columns


def test_jaccard_chain_over_blocks(spark, monkeypatch):
    """A chain of near copies, each linked with its neighbours only."""
    monkeypatch.setattr(jaccard, "CELL", 4)
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(5000)]
    text, rows = rng.choices(vocab, k=120), []
    for k in range(40):
        rows.append((k, " ".join(text)))
        at = (3 * k) % 110
        text = text[:at] + [rng.choice(vocab), rng.choice(vocab)] + text[at + 2:]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in jaccard.join(df).collect()) == components_by_force(rows)


def test_count_tree_loses_no_pair():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 400, rng.integers(5, 120))) for _ in range(120)]
    sizes, vectors = np.array([len(s) for s in sets]), jaccard.count_vectors(sets)
    tree = jaccard.CountTree(vectors, sizes)
    for i, s in enumerate(sets):
        near = set(tree.search(vectors[i], int(sizes[i])).tolist())
        for j, t in enumerate(sets):
            k = len(np.intersect1d(s, t))
            if 100 * k >= 75 * (len(s) + len(t) - k):
                assert j in near


def test_exact(docs, empty):
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    same = defaultdict(list)
    for d, t in rows:
        same[t.translate({ord(c): None for c in WHITE})].append((-len(t), d))
    got = sorted((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in exact.groups(docs).collect())
    assert got == sorted((d, min(g)[1], len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in same.items() for _, d in g)
    assert exact.groups(empty).count() == 0
    assert exact.keep_first(docs).columns == docs.columns


def test_counting_quotient_filter():
    rng = np.random.default_rng(2)
    a, b = (rng.integers(0, 1 << 63, 300).astype(np.uint64)[rng.integers(0, 300, 900)] for _ in range(2))
    b[:200] = a[:200]
    build = exact.CountingQuotientFilter.build
    merged = exact.CountingQuotientFilter.load(build(a).dump()).merge(build(b))
    true = Counter(a.tolist()) + Counter(b.tolist())
    assert dict(zip(merged.entries()[0].tolist(), merged.counts.tolist())) == dict(true)
    assert all(merged.count(k) == n for k, n in list(true.items())[:50]) and merged.count(12345) == 0


SECRETS = [
    'x password=abc123 y "api_key": "Zx9/+_.=-" token:abc', "AKIA" + "A1" * 10 + " AKIASHORT deadbeef" + "0123456789abcdef" * 2,
    "password:token:abcdefgh Secret = 'sssssss'", None, "", "plain words only", "é漢 passwd=ünicode secret=abcdefg " * 700,
    "key Zk3/9fQx7LmP2vR8tYw1BnC6dHs5 end", "this_is_an_ordinary_identifier_name and wonderful-hyphenated-compound",
]


def test_secrets(spark):
    docs = spark.createDataFrame([(k, t, "a", 1) for k, t in enumerate(SECRETS)], "doc_id long, text string, spans string, n_chars long")
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = secrets.fitted(spark, base)
    patterns = [re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
                re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")]
    keep = [lambda m: len(m[2]) >= 6, lambda m: len(m[0]) >= 20, lambda m: len(m[0]) >= 24]
    got = by_id(secrets.scan(docs, model))
    for k, t in enumerate(SECRETS):
        found = sorted((m.start(), i, m.end()) for i, p in enumerate(patterns) for m in p.finditer(t or "") if keep[i](m))
        written = ",".join(f"{secrets.KINDS[i]}:{a}:{b}" for a, i, b in found)
        assert got[k]["base_sha256"] == hashlib.sha256(written.encode()).hexdigest()
        assert [got[k][c] for c in ("n_assign", "n_access", "n_hex")] == [sum(f[1] == i for f in found) for i in range(3)]
    assert got[7]["spans"] == "markov:4:32" and got[8]["n_markov"] == 0 and got[5]["spans"] == ""
    clean = by_id(secrets.redact(docs, model))
    assert clean[7]["text"] == "key [SECRET] end" and clean[7]["n_chars"] == 16 and clean[5]["text"] == SECRETS[5] and clean[3]["text"] is None
    assert clean[2]["text"] == "password:token:abcdefgh [SECRET]'"
    held_out = spark.createDataFrame([(hashlib.sha1(str(i).encode()).hexdigest(), 1) for i in range(100)] +
                                     [("customer_account_number_" + w, 0) for w in words("alpha beta gamma delta epsilon")], "t string, y int")
    scored = held_out.select("y", secrets.ratio(held_out["t"], model).alias("s")).collect()
    assert all((r["s"] > secrets.MARGIN) == bool(r["y"]) for r in scored)


def held_out_tokens():
    """Secrets that no fixed pattern finds, and ordinary long tokens of words
    that the samples do not hold as such."""
    rng, alnum = random.Random(41), string.ascii_letters + string.digits
    pick = lambda a, n: "".join(rng.choices(a, k=n))
    few = range(150)
    found = {
        "mixed case": [pick(alnum, rng.randint(20, 40)) for _ in few],
        "base64": [base64.b64encode(rng.randbytes(rng.randint(15, 33))).decode() for _ in few],
        "url-safe": [base64.urlsafe_b64encode(rng.randbytes(32)).decode().rstrip("=") for _ in few],
        "upper case": [pick(string.ascii_uppercase + string.digits, 24) for _ in few],
        "lower case": [pick("ghijklmnopqrstuvwxyz" + string.digits, 32) for _ in few],
        "upper hex": [rng.randbytes(20).hex().upper() for _ in few],
        "with prefix": ["sk_live_" + pick(alnum, 28) for _ in few]}
    vocab = ("account archive balance buffer channel client column commit customer delivery document engine factory forecast garden harbour "
             "identifier journal kitchen ledger market neighbour observer package quarter railway schedule temperature umbrella village weather yesterday").split()
    w = lambda n: [rng.choice(vocab) for _ in range(n)]
    plain = {
        "snake": ["_".join(w(4)) for _ in few], "kebab": ["-".join(w(4)) for _ in few], "path": ["/".join(w(4)) for _ in few],
        "camel": ["".join(x.capitalize() for x in w(4)) for _ in few], "numbered": ["_".join(w(3)) + str(rng.randint(0, 9999)) for _ in few],
        "constants": ["_".join(w(4)).upper() for _ in few], "numbers": [pick(string.digits, 22) for _ in few],
        "dated": [f"20{rng.randint(10, 29)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}-" + "-".join(w(2)) for _ in few],
        "ruled": [c * n for c in "-=_+/" for n in range(20, 80, 2)]}
    return found, plain


def test_markov_models_held_out(spark):
    found, plain = held_out_tokens()
    rows = [(k, f"see {t} now") for k, t in enumerate(t for ts in [*found.values(), *plain.values()] for t in ts)]
    model = secrets.fitted(spark, spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    spans, at = [r["spans"] for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).orderBy("doc_id").collect()], 0
    share = {}
    for name, tokens in [*found.items(), *plain.items()]:
        share[name] = sum("markov" in s for s in spans[at:at + len(tokens)]) / len(tokens)
        at += len(tokens)
    assert all(share[name] >= 0.95 for name in found), share
    assert all(share[name] <= 0.08 for name in plain) and sum(share[name] for name in plain) <= 0.02 * len(plain), share


def test_licenses(spark, empty):
    mit = licenses.KNOWN["MIT"][2]
    rows = [(1, mit.upper()), (2, "Copyright (c) 2020 A B\n" + mit.replace("sublicense", "sub-license")), (3, "text\nlicensed under CC  BY-NC 4.0\nmore"),
            (4, None), (5, ""), (6, "Copyright 2001"), (3, "other"), (7, mit + " but not quite")]
    got = [(r["doc_id"], r["whole_license"], r["licenses"], r["n_notices"]) for r in
           licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), licenses.known_table(spark)).collect()]
    assert sorted(got, key=str) == sorted([
        (1, "MIT", "MIT", 1), (2, "MIT", "MIT", 1), (3, None, "CC-BY-NC-4.0", 1), (3, None, "CC-BY-NC-4.0", 1), (4, None, "", 0),
        (5, None, "", 0), (6, None, "", 0), (7, None, "", 0)], key=str)
    assert licenses.scan(empty, licenses.known_table(spark)).count() == 0


def test_lines_of_a_text_give_its_digest(spark):
    """Line by line and as a whole, a text normalises to the same; columns of
    any name may stand beside it, and repeated rows keep a row each."""
    ends = ["\n", "\r\n", "\r", "\x85", "\x0b", "\u2028", "\n\n", "\n \n"]
    lines = ["Copyright (c) 2020 X", "per", "cent & per cent", "ΑΣ", "σ licence", "(c) all of it", "© z", "", "#", "https://a.b/c"]
    texts = [None, "", "\n", "©", *(end.join(lines[i:] + lines[:i]) + end for end in ends for i in range(len(lines)))]
    rows = [(i, t, "line", "d", 7, "known") for i, t in enumerate(texts)] + [(2, "\n", "text", "d", 7, None)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind string, digest string, row int, joined string")
    known = licenses.known_table(spark)
    got = [(r["doc_id"], r["text_digest"]) for r in licenses.scan(docs, known).collect()]
    want = [tuple(r) for r in docs.select("doc_id", licenses.digest(F.coalesce("text", F.lit("")))).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len({d for _, d in want}) > 10


def test_whole_licenses(spark):
    """Texts as packages ship them, wrapped their own way, and quoted among other text."""
    import importlib.metadata
    from pathlib import Path

    import pyspark

    shipped = Path(pyspark.__file__).parent / "licenses"
    mit, isc = ((shipped / f"LICENSE-{x}.txt").read_text("utf-8") for x in ("respond", "d3.min.js"))
    apache = next(f for f in importlib.metadata.files("requests") if f.name == "LICENSE").read_text("utf-8")
    bsd = next(f for f in importlib.metadata.files("zstandard") if f.name == "LICENSE").read_text("utf-8")
    common = {k: Path(f"/usr/share/common-licenses/{k}") for k in ("GPL-3", "MPL-2.0")}
    # copies of license_texts, so wrapped anew; list items keep their lines
    anew = {k: re.sub(r"(?<=\S)\n(?=[a-z])", " ", p.read_text("utf-8")) for k, p in common.items() if p.exists()}
    quoted = "About this\n\n" + "".join(f" * {x}\r\n" for x in mit.splitlines()) + " *\r\n * int main()"
    cut = mit.split("THE SOFTWARE IS PROVIDED")[0]
    rows = [(1, mit, "MIT", "MIT"), (2, isc, "ISC", "ISC"), (3, apache, "Apache-2.0", "Apache-2.0"), (4, bsd, "BSD-3-Clause", "BSD-3-Clause"),
            (5, quoted, None, "MIT"), (6, f"{isc}\n\n{mit}\n\nand more", None, "ISC,MIT"), (7, "MIT License\n\n" + mit, "MIT", "MIT"),
            (8, "a\n\n" + cut + "b\n\n", None, ""), (9, cut + "b", None, ""), (9, mit.split("conditions:")[1], None, ""),
            *((20 + i, t, k.replace("GPL-3", "GPL-3.0"), k.replace("GPL-3", "GPL-3.0")) for i, (k, t) in enumerate(anew.items()))]
    got = {(r["doc_id"], r["whole_license"], r["licenses"]) for r in licenses.scan(
        spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), licenses.known_table(spark)).collect()}
    assert got == {(r[0], *r[2:]) for r in rows}
    for column in ("digest", "joined"):
        known = licenses.known_table(spark).select("license_id", column).distinct()
        assert known.count() == known.select(column).distinct().count()


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (102, 101)], "src long, dst long")
    got = {r["node"]: r["label"] for r in components.components(edges).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 102: 100}
