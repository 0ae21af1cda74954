"""Main-text extraction by a recurrent block labeller.

A page is read as a sequence of leaf blocks: runs of text between block-level
tags, each with the open elements around it.  A bidirectional LSTM in numpy
reads a vector of each block's tag path (hashed tags, classes and ids) and of
its hashed words, and labels every block with the whole page in view.  The
blocks labelled as main text are joined in page order.

The model is trained on the driver from ``TRAIN_PAGES`` generated pages whose
labels are known (bounded, with a fixed seed) and its weights, some 40 KB, are
sent with the tasks.  Labelling covers every block of every page.

Defined results: null and empty pages have the empty text; comments, scripts
and styles have no text, nor what an iframe holds in its place; images,
drawings, formulas and the like stand in the line, and their own text counts;
text that no tag surrounds is a block as well; element
depth is unlimited; repeated rows get a row each; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import functools
import html
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from quarry.llm.common import slices

TRAIN_PAGES = 600
EPOCHS = 12
HIDDEN = 16
PATH, LEAF, WORDS = 96, 32, 16
FEATURES = PATH + LEAF + WORDS + 3

# Elements of the HTML standard by how they take part in text flow.
#: Elements in the line that say nothing of the text in them: they do not count in the path.
TRANSPARENT = frozenset("audio canvas iframe map math noscript object picture svg template textarea video".split())
INLINE = TRANSPARENT | frozenset("area embed img input link meta param source track".split()) | frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style iframe noembed noframes".split())  # to the end tag
VERBATIM = frozenset("textarea xmp".split())  # text to the end tag, without tags in it
CLOSED_BY = {
    "p": frozenset("p div ul ol li table section article aside nav header footer main form h1 h2 h3 h4 h5 h6 pre "
                   "blockquote dl fieldset hr address figure".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]),
    "option": frozenset(["option", "optgroup"]), "head": frozenset(["body"]),
}
FOREIGN = ("svg", "math")
EMBEDS_HTML = ("foreignobject", "annotation-xml")
# Elements that end an svg or math left open.
BREAKS_OUT = CLOSED_BY["p"] | frozenset("body center dd dt head html li menu tbody td th thead tr".split())
BARRIERS = frozenset("ul ol table td th div section article aside main body form blockquote button".split())

CLOSERS = frozenset().union(*CLOSED_BY.values())
SECTIONS = (("<!--", "-->"), ("<![CDATA[", "]]>"))

_HEAD = re.compile(r"</?[a-zA-Z]")
# Tags, with no way back into what has been read: quotes may hide a ">", or not.
_QUOTED_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_PLAIN_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""")
_LONG_REFERENCE = re.compile(r"&#([0-9]{1000,})")  # int() refuses still longer ones
_NAMED = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_OPEN_VALUE = re.compile(r"""=\s*[^\s"'=]+\Z""")  # an unquoted value takes a slash at the end
_PART = re.compile(r"[a-z]+")


@functools.cache
def _slot(item: str, size: int) -> int:
    return zlib.crc32(item.encode("utf-8", "surrogatepass")) % size


@functools.lru_cache(4096)
def _bits(name: str, attributes: str) -> int:
    """What an element adds to the path: bits of its tag, classes and ids."""
    out = 1 << _slot("<" + name, PATH)
    for m in _NAMED.finditer(attributes) if "=" in attributes else ():
        for part in _PART.findall((m[2] or m[3] or m[4] or "").lower()):
            out |= 1 << _slot(part, PATH)
    return out


def _tags(page: str, skip: Callable[[str, str, int], int | None]) -> Iterator[tuple[str, re.Match | None]]:
    """(text before, tag) for every tag, and the text after the last with None.

    Reads forward only.  ``skip(name, attributes, end)`` says where to go on
    after a start tag, if not at its end.  A tag whose quotes are never closed
    ends at its first ">", and so do all tags after it."""
    text = at = 0  # where the text since the last tag starts, and where to look on
    quotes = True
    while (at := page.find("<", at)) >= 0:
        section = next((s for s in SECTIONS if page.startswith(s[0], at)), None)
        if section:
            end = page.find(section[1], at + len(section[0]))
            yield page[text:at], None
            text = at = len(page) if end < 0 else end + len(section[1])
            continue
        if page.startswith(("<!", "<?"), at):
            end = page.find(">", at)
            if end < 0:  # no tag can end any more
                break
            yield page[text:at], None
            text = at = end + 1
            continue
        if not _HEAD.match(page, at):
            at += 1
            continue
        m = _QUOTED_TAG.match(page, at) if quotes else None
        if m is None:
            quotes = False
            m = _PLAIN_TAG.match(page, at)
            if m is None:
                break
        yield page[text:at], m
        to = None if m[1] else skip(m[2].lower(), m[3], m.end())
        text = at = m.end() if to is None else to
    rest = page[text:]
    for start, _ in SECTIONS:  # those have no end
        rest = rest.split(start, 1)[0]
    yield rest, None


def blocks(page: str) -> list[tuple[str, str, int]]:
    """(text, block-level tag, path bits) of each leaf block, in page order, in
    time linear in the page."""
    page = _LONG_REFERENCE.sub(lambda m: "&#" + (m[1].lstrip("0")[:8] or "0"), page)
    stack: list[tuple[str, str, int]] = []  # element, nearest block-level element, path
    stops: list[int] = []  # places in it of elements that another may close, or that keep it from looking further
    depth: dict[str, int] = {}
    endless: set[str] = set()  # elements without an end tag in the rest of the page
    out, held, owner = [], [], None

    def flush():
        nonlocal owner
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                out.append((text, *(owner or ("", 0))))
            held.clear()
        owner = None

    def take(text):
        nonlocal owner
        if text:
            if owner is None and stack and not text.isspace():
                owner = stack[-1][1:]
            held.append(text)

    def pop_to(name):
        while stack:
            top = stack.pop()[0]
            if stops and stops[-1] == len(stack):
                stops.pop()
            depth[top] -= 1
            if top == name:
                return

    def is_foreign():
        return any(depth.get(x) for x in FOREIGN) and not any(depth.get(x) for x in EMBEDS_HTML)

    def closed_itself(name, attributes):
        return attributes.endswith("/") and not _OPEN_VALUE.search(attributes[-200:])

    def skip(name, attributes, at):
        """Past the content of elements that have no blocks in it."""
        if name not in SKIPPED and name not in VERBATIM or closed_itself(name, attributes):
            return None
        end = None if name in endless else re.compile(rf"</{re.escape(name)}\s*+>", re.I).search(page, at)
        if end is None:
            endless.add(name)
        if name in VERBATIM:
            take(page[at:end.start() if end else len(page)].replace("<", "&lt;"))
            if name not in INLINE:
                flush()
        if end or name in ("script", "style") or name in VERBATIM:
            return end.end() if end else len(page)
        return None

    for text, m in _tags(page, skip):
        take(text)
        if m is None:
            continue
        name, attributes, closing = m[2].lower(), m[3], bool(m[1])
        foreign = is_foreign()
        if foreign and name in BREAKS_OUT:
            if not closing:
                for x in FOREIGN:
                    if depth.get(x):
                        pop_to(x)
            foreign = False
        if foreign and name not in INLINE:
            take(" ")
        elif name not in INLINE:
            if name == "br":
                take("\n")
                continue
            flush()
        if closing:
            if depth.get(name):
                pop_to(name)
            continue
        through = foreign or name in TRANSPARENT
        if name in SKIPPED or name in VERBATIM or name in VOID or through and closed_itself(name, attributes):
            continue
        if foreign:
            stack.append((name, *(stack[-1][1:] if stack else ("", 0))))
            depth[name] = depth.get(name, 0) + 1
            continue
        if name in CLOSERS:
            k = len(stops) - 1  # up to a barrier each kind of element is open once at most
            while k >= 0:
                element = stack[stops[k]][0]
                if name in CLOSED_BY.get(element, ()):
                    pop_to(element)
                elif element in BARRIERS:
                    break
                k -= 1
        block, path = stack[-1][1:] if stack else ("", 0)
        if name in CLOSED_BY or name in BARRIERS:
            stops.append(len(stack))
        stack.append((name, block if name in INLINE else name, path if through else path | _bits(name, attributes)))
        depth[name] = depth.get(name, 0) + 1
    flush()
    return out


def features(found: list[tuple[str, str, int]]) -> np.ndarray:
    """One row per block: path, leaf tag, hashed words, lengths."""
    out = np.zeros((len(found), FEATURES), np.float32)
    if not found:
        return out
    paths = np.frombuffer(b"".join(b[2].to_bytes(PATH // 8, "little") for b in found), np.uint8).reshape(len(found), -1)
    out[:, :PATH] = np.unpackbits(paths, axis=1, bitorder="little")
    out[np.arange(len(found)), [PATH + _slot("<" + b[1], LEAF) for b in found]] = 1
    raw = [b[0].lower().encode("utf-8", "surrogatepass") for b in found]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    ends = np.flatnonzero((data == 32) | (data == 10))
    starts = np.concatenate(([0], ends[:-1] + 1))
    # a word's hash: its bytes, each weighted by its distance from the word's end
    sums = np.concatenate(([0], np.cumsum(data, dtype=np.int64)))
    weighted = np.concatenate(([0], np.cumsum(data * np.arange(len(data), dtype=np.int64))))
    words = ends * (sums[ends] - sums[starts]) - (weighted[ends] - weighted[starts])
    last = np.cumsum([len(r) + 1 for r in raw]) - 1
    block = np.searchsorted(last, starts)
    count = np.bincount(block, minlength=len(found))
    hashed = np.bincount(block * WORDS + words % WORDS, minlength=len(found) * WORDS).reshape(-1, WORDS)
    out[:, PATH + LEAF:-3] = hashed / np.maximum(count, 1)[:, None]
    out[:, -3] = np.log1p([len(r) for r in raw]) / 8
    out[:, -2] = np.log1p(count) / 6
    out[:, -1] = np.isin(data[last - 1], list(b".!?"))
    return out


class Labeller:
    """Bidirectional LSTM over block vectors, with a score per block."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> "Labeller":
        scale = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        w = {}
        for d in "fb":
            w |= {f"x{d}": scale(FEATURES, 4 * HIDDEN), f"h{d}": scale(HIDDEN, 4 * HIDDEN), f"c{d}": np.zeros(4 * HIDDEN, np.float32)}
            w[f"c{d}"][HIDDEN:2 * HIDDEN] = 1  # remember at first
        return cls(w | {"o": scale(2 * HIDDEN, 1), "s": scale(FEATURES, 1) * 0.1, "b": np.zeros(1, np.float32)})

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str):
        """States of one direction; x is (time, batch, features)."""
        steps, n, _ = x.shape
        z = x @ self.w["x" + d] + self.w["c" + d]
        h = c = np.zeros((n, HIDDEN), np.float32)
        kept, order = [None] * steps, range(steps) if d == "f" else range(steps - 1, -1, -1)
        for t in order:
            g = z[t] + h @ self.w["h" + d]
            gates = 1 / (1 + np.exp(-np.clip(g[:, :3 * HIDDEN], -30, 30)))
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN:2 * HIDDEN], gates[:, 2 * HIDDEN:]
            a = np.tanh(g[:, 3 * HIDDEN:])
            m = mask[t][:, None]
            c2 = f * c + i * a
            s = np.tanh(c2)
            kept[t] = (h, c, i, f, o, a, s, m)
            h, c = np.where(m, o * s, h), np.where(m, c2, c)
            z[t, :, :HIDDEN] = h  # the gates' inputs are used up; their place takes the state
        return z[:, :, :HIDDEN], kept

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        hf, hb = self._run(x, mask, "f")[0], self._run(x, mask, "b")[0]
        return (np.concatenate((hf, hb), 2) @ self.w["o"] + x @ self.w["s"] + self.w["b"])[:, :, 0]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean logistic loss over unmasked blocks."""
        (hf, kf), (hb, kb) = self._run(x, mask, "f"), self._run(x, mask, "b")
        both = np.concatenate((hf, hb), 2)
        p = 1 / (1 + np.exp(-(both @ self.w["o"] + x @ self.w["s"] + self.w["b"])[:, :, 0]))
        d = ((p - y) * mask / mask.sum()).astype(np.float32)[:, :, None]
        out = {"o": np.einsum("tbh,tbk->hk", both, d), "s": np.einsum("tbh,tbk->hk", x, d), "b": d.sum((0, 1))}
        back = d @ self.w["o"].T
        for name, kept, part in (("f", kf, back[:, :, :HIDDEN]), ("b", kb, back[:, :, HIDDEN:])):
            gx = np.zeros((x.shape[0], x.shape[1], 4 * HIDDEN), np.float32)
            gh, dh, dc = np.zeros_like(self.w["h" + name]), 0.0, 0.0
            for t in range(len(kept) - 1, -1, -1) if name == "f" else range(len(kept)):
                h, c, i, f, o, a, s, m = kept[t]
                own = part[t] + dh
                cell = dc + own * o * (1 - s * s)
                g = np.concatenate((cell * a * i * (1 - i), cell * c * f * (1 - f), own * s * o * (1 - o), cell * i * (1 - a * a)), 1) * m
                gx[t] = g
                gh += h.T @ g
                dh = np.where(m, g @ self.w["h" + name].T, dh + part[t])
                dc = np.where(m, cell * f, dc)
            out |= {"x" + name: np.einsum("tbf,tbg->fg", x, gx), "c" + name: gx.sum((0, 1)), "h" + name: gh}
        return out


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x = np.zeros((steps, len(pages), FEATURES), np.float32)
    mask = np.zeros((steps, len(pages)), bool)
    for k, p in enumerate(pages):
        x[:len(p), k], mask[:len(p), k] = p, True
    return x, mask


def example(rng: np.random.Generator) -> tuple[str, list[bool]]:
    """A generated page and the label of each of its blocks."""
    letters = "abcdefghijklmnopqrstuvwxyzäéñ"
    word = lambda: "".join(rng.choice(list(letters), rng.integers(1, 9)))
    words = lambda a, b: " ".join(word() for _ in range(rng.integers(a, b)))
    sentence = lambda a, b: words(a, b).capitalize() + str(rng.choice([".", ".", "!", ""]))
    pick = lambda *x: str(rng.choice(x))
    out, labels = [], []

    def add(markup, *marks):
        out.append(markup)
        labels.extend(marks)

    def links(tag, label, n):
        items = [words(1, 3) for _ in range(n)]
        if tag == "nav" and rng.random() < 0.3:  # links in the line
            add("<nav>" + pick(" ", " | ").join(f"<a>{w}</a>" for w in items[:int(rng.integers(1, n + 1))]) + "</nav>", label)
            return
        add(f"<{tag}><ul>" + "".join(f'<li><a href="/{i}">{w}</a></li>' for i, w in enumerate(items)) + f"</{tag.split()[0]}>", *[label] * n)

    def plain(tag, label, a=2, b=30):
        add(f"<{tag}>{sentence(a, b)}</{tag.split()[0]}>", label)

    def boiler():
        kind = rng.integers(0, 8)
        if kind == 0:
            plain(pick('div class="ad"', 'div class="advert"', 'div class="sponsored banner"', 'div id="ads"', 'div class="promo"'), False)
        elif kind == 1:
            links(pick("nav", 'div class="menu"', 'ul class="menu"', 'div id="nav"', 'div class="breadcrumb"'), False, int(rng.integers(2, 7)))
        elif kind == 2:
            plain(pick("aside", 'div class="sidebar"', 'div class="related"', 'div id="sidebar"'), False)
        elif kind == 3:
            plain(pick('div class="cookie notice"', 'div id="cookie-banner"', 'div class="notice"', 'div class="alert"', 'div role="alert"'), False)
        elif kind == 4:
            add(f"<form><label>{words(1, 3)}</label><input name=q><button>{word()}</button></form>", False, False)
        elif kind == 5:
            n = int(rng.integers(1, 5))
            tag = pick('section class="comments"', 'div id="comments"', 'ol class="comment-list"')
            add(f"<{tag}>" + "".join(f'<div class="comment"><p>{sentence(3, 25)}</p></div>' for _ in range(n)) + f"</{tag.split()[0]}>", *[False] * n)
        elif kind == 6:
            plain("header", False, 1, 8)
        else:
            plain(pick('div class="share social"', 'div class="newsletter"', 'div class="popup"'), False, 1, 8)

    def rare():
        """What stands in fewer articles, and is text of theirs all the same."""
        kind, n = rng.integers(0, 12), int(rng.integers(1, 4))
        if kind == 0:
            add("<table>" + pick("", "<thead>") + "<tr>" + "".join(f"<th>{words(1, 3).capitalize()}</th>" for _ in range(n)) + "</tr>"
                + "".join("<tr>" + "".join(f"<td>{words(1, 3)}</td>" for _ in range(n)) + "</tr>" for _ in range(n)) + "</table>", *[True] * (n + n * n))
        elif kind == 1:
            add(f"<table><caption>{sentence(1, 9)}</caption><tr><th>{words(1, 3)}<td>{words(1, 4)}</table>", True, True, True)
        elif kind == 2:
            add(f'<figure><img src="/a.png"><figcaption>{sentence(2, 14)}</figcaption></figure>', True)
        elif kind in (3, 10, 11):
            plain(pick("div", "div", "div", "section", "center"), True, 3, 50)
        elif kind == 4:
            add("<dl>" + "".join(f"<dt>{words(1, 3)}</dt><dd>{sentence(2, 14)}</dd>" for _ in range(n)) + "</dl>", *[True] * 2 * n)
        elif kind == 5:
            plain(pick("h3", "h4", "h5", "h6"), True, 1, 7)
        elif kind == 6:
            add("<ol>" + "".join(f"<li>{sentence(1, 14)}</li>" for _ in range(n)) + "</ol>", *[True] * n)
        elif kind == 7:
            add(f"<section><h2>{words(1, 6)}</h2><p>{sentence(4, 40)}</p></section>", True, True)
        elif kind == 8:
            add(f"<details><summary>{words(1, 6)}</summary><p>{sentence(4, 30)}</p></details>", True, True)
        else:
            add(f"<div><div>{sentence(4, 40)}</div><div>{sentence(4, 40)}</div></div>", True, True)

    add(f"<!DOCTYPE html><html><head><meta charset=utf-8><title>{words(2, 9)}</title><style>p{{margin:0}}</style><script>var t=\"</p>\";</script></head><body>", False)
    if rng.random() < 0.8:
        links("nav", False, int(rng.integers(2, 8)))
    if rng.random() < 0.3:
        plain("header", False, 1, 8)
    for _ in range(rng.integers(0, 3)):
        boiler()
    if rng.random() < 0.6:
        plain('div class="ad"', False)
    outer = pick("article", "article", "article", "main", "main", "main", 'div class="content"', 'div class="article body"', 'div id="content"', 'div class="post entry"', 'main id="main"')
    out.append(f"<{outer}>")
    if rng.random() < 0.85:
        add(pick(f"<h1>{words(1, 12)}</h1>", f"<h1>{words(1, 12)}</h1>", f"<header><h1>{words(1, 12)}</h1></header>"), True)
    for k in range(int(rng.integers(1, 4)) if rng.random() < 0.4 else int(rng.integers(1, 26))):
        kind = rng.random()
        text = sentence(1, 5) if rng.random() < 0.3 else sentence(4, 60)
        if rng.random() < 0.1:
            text = " ".join(w.upper() + "!!" for w in text.split())
        if kind < 0.72:
            add(pick(f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br>", f"<p>{text} <a href=x>{word()}</a> {word()}</p>"), True)
        elif kind < 0.8:
            add(f"<h2>{words(1, 7)}</h2>", True)
        elif kind < 0.86:
            add(f"<blockquote>{text}</blockquote>", True)
        elif kind < 0.92:
            n = int(rng.integers(1, 5))
            add("<ul>" + "".join(f"<li>{sentence(1, 12)}</li>" for _ in range(n)) + "</ul>", *[True] * n)
        elif kind < 0.95:
            n = int(rng.integers(1, 4))
            add("<table>" + "".join(f"<tr><td>{words(1, 4)}</td><td>{words(1, 4)}</td></tr>" for _ in range(n)) + "</table>", *[True] * 2 * n)
        elif kind < 0.98:
            plain(pick('div class="ad"', "aside", 'div class="related"', 'div class="share social"', 'div class="notice"'), False)
        else:
            add(f"<pre>{text}</pre>", True)
        if rng.random() < 0.2:
            rare()
    out.append(f"</{outer.split()[0]}>")
    for _ in range(rng.integers(0, 3)):
        boiler()
    if rng.random() < 0.85:
        add(f"<footer>&copy; {words(1, 3)} &middot; {sentence(2, 14)}</footer>", False)
    return "".join(out) + ("</body></html>" if rng.random() < 0.8 else ""), labels


@functools.cache
def trained() -> Labeller:
    """The model of the registered query, fitted once in a driver's life."""
    return train()


def train(pages: int = TRAIN_PAGES, epochs: int = EPOCHS, seed: int = 7) -> Labeller:
    """Adam on generated pages, batches of like length."""
    rng = np.random.default_rng(seed)
    data = []
    for _ in range(pages):
        page, labels = example(rng)
        found = blocks(page)
        assert len(found) == len(labels), (len(found), len(labels), page)
        data.append((features(found), np.array(labels, np.float32)))
    data.sort(key=lambda d: len(d[1]))
    batches = [data[i:i + 24] for i in range(0, len(data), 24)]
    model = Labeller.fresh(rng)
    first = {k: np.zeros_like(v) for k, v in model.w.items()}
    second = {k: np.zeros_like(v) for k, v in model.w.items()}
    step = 0
    for epoch in range(epochs):
        rate = 0.02 * (1 - epoch / epochs) + 0.001
        for k in rng.permutation(len(batches)):
            x, mask = _padded([d[0] for d in batches[k]])
            y = np.zeros(mask.shape, np.float32)
            for j, d in enumerate(batches[k]):
                y[:len(d[1]), j] = d[1]
            step += 1
            for name, g in model.gradients(x, mask, y).items():
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.99 * second[name] + 0.01 * g * g
                model.w[name] = (model.w[name] - rate * (first[name] / (1 - 0.9 ** step))
                                 / (np.sqrt(second[name] / (1 - 0.99 ** step)) + 1e-7)).astype(np.float32)
    return model


def label(model: Labeller, pages: list[list]) -> list[np.ndarray]:
    """Which blocks of each page are main text; pages of like length share a
    batch, and a batch holds a bounded number of blocks unless one page is
    longer."""
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    every = features([b for page in pages for b in page])
    own = np.split(every, np.cumsum([len(p) for p in pages])[:-1]) if pages else []
    order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
    i = 0
    while i < len(order):
        j = i + 1
        while j < len(order) and (j - i + 1) * len(pages[order[j]]) <= 16_384 and j - i < 256:
            j += 1
        x, mask = _padded([own[k] for k in order[i:j]])
        scores = model.scores(x, mask)
        for b, k in enumerate(order[i:j]):
            out[k] = scores[:len(pages[k]), b] > 0
        i = j
    return out


def main_text(model: Labeller, pages: list[str | None]) -> list[str]:
    found = [blocks(p or "") for p in pages]
    return ["\n".join(b[0] for b, keep in zip(own, kept) if keep) for own, kept in zip(found, label(model, found))]


def extract(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    weights = (model or trained()).w
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = Labeller(weights)
        for batch in batches:
            sizes = np.cumsum([x or 0 for x in pc.binary_length(batch.column("html")).to_pylist()])
            for i, j in slices(np.concatenate(([0], sizes))):
                part = batch.slice(i, j - i)
                texts = main_text(use, part.column("html").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(
        run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
