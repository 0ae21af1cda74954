"""Small lenient HTML tree on the standard-library parser (no bs4 here).

Used inside Arrow batches by ``operators.html_jobs``: parse once per row,
then select text, drop noise or render Markdown.  Only the subset the
operators need: tags, attributes, text, void elements, lenient closing.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
RAW = {"script", "style"}
NOISE_SECTION_CLASS = "MuutoksenhakuohjeetSektio"  # appeal-instruction boilerplate (fixed value)


# Elements whose end tag the HTML standard lets the next element imply, and where the search for them stops.
ENDED_BY = {
    "p": frozenset("p div ul ol li table section article aside nav header footer main form h1 h2 h3 h4 h5 h6 pre blockquote dl".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]),
}
ENDS_SEARCH = frozenset("ul ol dl table div section article aside main body html form blockquote #root".split())


ENDS_SOMETHING = frozenset().union(*ENDED_BY.values())

LISTS = frozenset(["ul", "ol"])
HEADINGS = frozenset(f"h{i}" for i in range(1, 7))
BLOCKS = LISTS | HEADINGS | frozenset("p table div section article main aside header footer form blockquote pre dl figure body html".split())


class Node:
    __slots__ = ("tag", "attrs", "children", "parent", "has_block")

    def __init__(self, tag, attrs=None, parent=None):
        self.tag = tag
        self.attrs = dict(attrs or {})
        self.children = []
        self.parent = parent
        self.has_block = False  # some element below is a block

    def classes(self):
        return (self.attrs.get("class") or "").split()


class _Builder(HTMLParser):
    """Every element is opened and closed once; which open element an end tag
    or an implied end closes is looked up, not searched for."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.cur = self.root
        self.open_by_tag: dict[str, list[Node]] = {}
        self.stops = [self.root]  # open elements that end the search, or that an element may end

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_SOMETHING:
            self._implied_ends(tag)
        n = self._add(tag, attrs)
        if tag not in VOID:
            self.cur = n
            self.open_by_tag.setdefault(tag, []).append(n)
            if tag in ENDED_BY or tag in ENDS_SEARCH:
                self.stops.append(n)

    def handle_startendtag(self, tag, attrs):
        self._add(tag, attrs)

    def _add(self, tag, attrs) -> Node:
        n = Node(tag, attrs, self.cur)
        self.cur.children.append(n)
        if tag in BLOCKS:
            up = self.cur
            while up is not None and not up.has_block:
                up.has_block = True
                up = up.parent
        return n

    def _close(self, node: Node) -> None:
        """Close ``node`` and all that is open in it."""
        while True:
            n = self.cur
            self.open_by_tag[n.tag].pop()
            if self.stops[-1] is n:
                self.stops.pop()
            self.cur = n.parent
            if n is node:
                return

    def _implied_ends(self, tag):
        """Close what the new element cannot stand in: a paragraph ends where
        a block starts, an item or cell where its next one starts.  Up to where
        the search stops each kind of such elements is open once at most."""
        at = len(self.stops) - 1
        while self.stops[at].tag not in ENDS_SEARCH:
            n, at = self.stops[at], at - 1
            if tag in ENDED_BY[n.tag]:
                self._close(n)

    def handle_endtag(self, tag):
        held = self.open_by_tag.get(tag)
        if held:
            self._close(held[-1])

    def handle_data(self, data):
        self.cur.children.append(data)

    def parse_marked_section(self, i, report=1):
        """One of an unknown kind is a comment up to the next ">"."""
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            return self.parse_bogus_comment(i)


_LONG_REFERENCE = re.compile(r"&#([0-9]{1000,})")  # int() refuses still longer ones


def parse(html: str | None) -> Node:
    """The tree of a page.  After the last ">" no tag can end, so a "<" there
    is text (or part of a script or comment that is still open)."""
    b = _Builder()
    page = _LONG_REFERENCE.sub(lambda m: "&#" + (m[1].lstrip("0")[:8] or "0"), html or "")
    cut = page.rfind(">") + 1
    b.feed(page[:cut])
    rest = page[cut:]
    b.feed(rest if b.cdata_elem or b.rawdata else rest.replace("<", "&lt;"))
    b.close()
    return b.root


def walk(node: Node):
    """("open" | "text" | "close", item) in document order, without recursion:
    pages may nest as deep as they like."""
    stack = [iter(node.children)]
    open_ = [node]
    while stack:
        c = next(stack[-1], None)
        if c is None:
            stack.pop()
            done = open_.pop()
            if done is not node:
                yield "close", done
        elif isinstance(c, Node):
            yield "open", c
            stack.append(iter(c.children))
            open_.append(c)
        else:
            yield "text", c


def iter_nodes(node: Node):
    return (c for event, c in walk(node) if event == "open")


def text_of(node: Node, strip: bool = False, sep: str = "") -> str:
    parts = [c.strip() if strip else c for event, c in walk(node) if event == "text"]
    return sep.join(p for p in parts if p) if strip else sep.join(parts)


def _matches(n: Node, selector: str) -> bool:
    tag, _, cls = selector.partition(".")
    return (not tag or n.tag == tag) and (not cls or cls in n.classes())


def select_one(root: Node, selector: str):
    for n in iter_nodes(root):
        if _matches(n, selector):
            return n
    return None


def remove_noise(root: Node) -> Node:
    """Drop every img element and every appeal-instruction section."""
    def noise(c):
        return isinstance(c, Node) and (c.tag == "img" or (c.tag == "section" and NOISE_SECTION_CLASS in c.classes()))

    todo = [root]
    while todo:
        n = todo.pop()
        n.children = [c for c in n.children if not noise(c)]
        todo += [c for c in n.children if isinstance(c, Node)]
    return root


def serialize(n: Node) -> str:
    from html import escape
    out, tags = [], [n.tag]
    for event, c in walk(n):
        if event == "open":
            out.append(f"<{c.tag}" + "".join(f' {k}="{escape(v or "", quote=True)}"' for k, v in c.attrs.items()) + ">")
            tags.append(c.tag)
        elif event == "close":
            tags.pop()
            if c.tag not in VOID:
                out.append(f"</{c.tag}>")
        else:
            out.append(c if tags[-1] in RAW else escape(c, quote=False))
    return "".join(out)


def _walk_but(node: Node, skip: frozenset, skipped: list | None = None):
    """``walk`` that does not enter elements of ``skip``; they are collected."""
    stack, open_ = [iter(node.children)], [node]
    while stack:
        c = next(stack[-1], None)
        if c is None:
            stack.pop()
            done = open_.pop()
            if done is not node:
                yield "close", done
        elif not isinstance(c, Node):
            yield "text", c
        elif c.tag not in skip:
            yield "open", c
            stack.append(iter(c.children))
            open_.append(c)
        elif skipped is not None:
            skipped.append(c)


QUIET = frozenset(RAW | {"head", "title"})
MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*"}


class _Inline:
    """Text with emphasis and links in one list of pieces, built in one pass.

    An element with a mark keeps the place of its opening mark.  White space
    that turns out to stand right after an opening mark or right before a
    closing one is dropped when that is known; every piece is dropped once."""

    def __init__(self):
        self.parts: list[str] = []
        self.open: list[tuple[int, str, str]] = []  # place, opening and closing mark
        self.seen = 0  # of these, so many have visible text; they are the outer ones
        self.last = -1  # the last visible piece

    def text(self, data: str) -> None:
        if not data.strip():
            self.parts.append(data)
            return
        if self.seen < len(self.open):
            first = self.open[self.seen][0]
            for at in range(first, len(self.parts)):
                self.parts[at] = ""
            for place, mark, _ in self.open[self.seen:]:
                self.parts[place] = mark
            self.seen = len(self.open)
            data = data.lstrip()
        self.last = len(self.parts)
        self.parts.append(data)

    def begin(self, mark: str, closing: str) -> None:
        self.open.append((len(self.parts), mark, closing))
        self.parts.append("")

    def end(self) -> None:
        _, _, closing = self.open.pop()
        if self.seen > len(self.open):
            self.seen -= 1
            del self.parts[self.last + 1:]
            self.parts[self.last] = self.parts[self.last].rstrip()
            self.last = len(self.parts)
            self.parts.append(closing)


def _inline(n: Node, skip: frozenset = frozenset(), skipped: list | None = None) -> str:
    """Text with emphasis and link targets; elements in ``skip`` (which go to
    ``skipped``) and those without visible text are left out."""
    out, marked = _Inline(), []
    for event, c in _walk_but(n, QUIET | skip, skipped):
        if event == "text":
            out.text(c)
            continue
        if event == "close":
            if marked.pop():
                out.end()
            if c.tag in BLOCKS:
                out.text(" ")
            continue
        if c.tag in BLOCKS:
            out.text(" ")
        mark = MARKS.get(c.tag)
        link = c.attrs.get("href") if c.tag == "a" else None
        marked.append(bool(mark or link))
        if mark:
            out.begin(mark, mark)
        elif link:
            out.begin("[", f"]({link})")
        elif c.tag == "br":
            out.text("\n")
    return "".join(out.parts)


def _norm(s: str) -> str:
    return " ".join(s.split())


def _list_lines(top: Node) -> list[str]:
    """Items of a list and of the lists in it, these indented."""
    lines, todo = [], [(top, 0, iter(top.children), [0])]
    while todo:
        own, depth, rest, number = todo[-1]
        c = next(rest, None)
        if c is None:
            todo.pop()
        elif isinstance(c, Node) and c.tag in LISTS:
            todo.append((c, depth + 1, iter(c.children), [0]))
        else:  # an item, or what stands between items
            inner: list[Node] = []
            item = isinstance(c, Node) and c.tag == "li"
            number[0] += item
            t = _norm(_inline(c, LISTS, inner) if isinstance(c, Node) else c)
            if t:
                lines.append("  " * depth + ("" if not item else f"{number[0]}. " if own.tag == "ol" else "- ") + t)
            todo += [(x, depth + 1, iter(x.children), [0]) for x in reversed(inner) if x.tag in LISTS]
    return lines


def _table_lines(table: Node) -> list[str]:
    """A line per row; rows of a table in a cell follow the row of that cell."""
    lines = []
    for r in (x for x in iter_nodes(table) if x.tag == "tr"):
        cells = [_norm(_inline(x, TABLE)) for x in r.children if isinstance(x, Node) and x.tag in ("td", "th")]
        lines.append("| " + " | ".join(cells) + " |")
        if len(lines) == 1:
            lines.append("|" + "|".join(["---"] * max(len(cells), 1)) + "|")
    return lines


TABLE = frozenset(["table"])


def to_markdown(root: Node) -> str:
    """Headings, paragraphs, lists, tables, links and emphasis to Markdown, in
    time linear in the page but for the indentation of deep lists.

    Text and inline elements side by side in a container are one paragraph."""
    out, run = [], Node("#run")

    def close():
        t = _norm(_inline(run))
        if t:
            out.append(t)
        run.children = []

    todo = [iter(root.children)]
    while todo:
        c = next(todo[-1], None)
        if c is None:
            todo.pop()
            close()
            continue
        tag = c.tag if isinstance(c, Node) else None
        if tag is None or tag not in BLOCKS and not c.has_block:
            if tag not in RAW and tag not in ("head", "title", "nav", "img"):
                run.children.append(c)
            continue
        close()
        if tag == "head" or tag == "nav":
            continue
        if tag in HEADINGS:
            t = _norm(_inline(c))
            out += ["#" * int(tag[1]) + " " + t] if t else []
        elif tag in LISTS or tag == "table":
            lines = _list_lines(c) if tag in LISTS else _table_lines(c)
            out += ["\n".join(lines)] if lines else []
        else:
            todo.append(iter(c.children))
    return "\n\n".join(out)


def html_to_markdown(html: str | None) -> str:
    """Backslashes removed, noise dropped, then Markdown."""
    if not html or not html.strip():
        return ""
    return to_markdown(remove_noise(parse(html.replace("\\", ""))))


def strip_noise(html: str | None) -> str:
    if not html or not html.strip():
        return ""
    return serialize(remove_noise(parse(html.replace("\\", ""))))
