"""Page shredding (X1): HTML text → one struct per page with its elements in document order.

The only Python that runs on page text. It is an Arrow UDF, so batches of pages cross to Python once
and come back as columns; everything after it is Spark expressions. Element rows carry interval ids
(``pos``..``end_pos``), the chain of ancestors and offsets into the page text, so no text is stored
twice and containment is a slice or an equality.

Follows HTML tree construction with implied html/head/body, implied end tags and reopened formatting
elements. Not done: moving misplaced table content, the full misnesting repair of end tags.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Iterator
from html import unescape
from html.entities import html5
from operator import attrgetter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

MAX_DEPTH = 512  # deeper elements become siblings, as browsers do; bounds the ancestor chains
RUN_BYTES = 1 << 19  # source that is taken apart at once

_TOKEN = re.compile(
    r"<!--(?P<comment>.*?)(?:--!?>|\Z)"
    r"|<[!?](?P<decl>[^>]*)>"
    r"|</(?P<close>[A-Za-z][^\s/>]*)[^>]*>"
    r"""|<(?P<open>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>=]++|=\s*+(?:"[^"]*"|'[^']*'|))*+)>""",
    re.S,
)
_ATTR = re.compile(r"""([^\s=/>][^\s=/>]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")

# Element classes of the HTML standard.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style xmp iframe noembed noframes noscript".split())
_ESCAPABLE_RAW = frozenset("title textarea".split())
_HEAD = frozenset("base basefont bgsound link meta noframes script style template title noscript".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr listing main menu nav ol p plaintext pre section summary table ul xmp "
    "li dd dt".split()
)
_FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
_SCOPE_EDGE = frozenset("applet caption html table td th marquee object template".split())
_TABLE_PARTS = frozenset("caption col colgroup tbody td tfoot th thead tr".split())
_SPECIAL = _CLOSES_P | _SCOPE_EDGE | _TABLE_PARTS | _HEAD | _VOID - {"area"} | frozenset(
    "body button head iframe input select textarea noembed".split()
)
_UNLISTED = frozenset("script style noscript svg".split())

NODE = pa.struct(
    [
        ("pos", pa.int32()), ("end_pos", pa.int32()), ("parent_pos", pa.int32()),
        ("el_idx", pa.int32()), ("type_idx", pa.int32()), ("n_type", pa.int32()), ("n_el", pa.int32()),
        ("node_id", pa.int32()), ("end_id", pa.int32()), ("parent_id", pa.int32()),
        ("sib_idx", pa.int32()), ("depth", pa.int32()),
        ("tag", pa.string()), ("id_attr", pa.string()), ("classes", pa.list_(pa.string())),
        ("attrs", pa.map_(pa.string(), pa.string())), ("own_text", pa.string()),
        ("t0", pa.int32()), ("t1", pa.int32()),
        ("o0", pa.int32()), ("o1", pa.int32()), ("i0", pa.int32()), ("i1", pa.int32()),
        ("path", pa.list_(pa.int32())), ("child_sig", pa.string()),
    ]
)
PAGE = pa.struct([("nodes", pa.list_(NODE)), ("text", pa.string()), ("html", pa.string())])

PAGE_TYPE = from_arrow_type(PAGE)

_ENTITY = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|([A-Za-z][A-Za-z0-9]*)(;?))(?P<eq>=?)")


def _unescape_attr(v: str) -> str:
    """In attributes a name without ';' is an entity only when it stands alone: '&copy=1' is kept."""

    def one(m: re.Match) -> str:
        name, semi = m[1], m[2]
        if name and not semi and (m["eq"] or name not in html5):
            return m[0]
        return unescape(m[0][: len(m[0]) - len(m["eq"])]) + m["eq"]

    return _ENTITY.sub(one, v)


def _escape(s: str, attr: bool = False) -> str:
    s = s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    return s.replace('"', "&#34;") if attr else s.replace("'", "&#39;").replace('"', "&#34;")


class _Node:
    __slots__ = (
        "pos", "end_pos", "parent", "tag", "attrs", "own", "kids", "n_kids", "n_listed", "labels", "path",
        "el_idx", "type_idx", "node_id", "end_id", "sib_idx", "t0", "t1", "o0", "o1", "i0", "i1",
    )

    def __init__(self, pos: int, tag: str, attrs: dict[str, str], parent: _Node | None, t: int, o: int):
        self.pos, self.tag, self.attrs, self.parent = pos, tag, attrs, parent
        self.own: list[str] = []
        self.kids: dict[str, int] = {}
        self.labels: list[str] = []
        self.n_kids = self.n_listed = self.node_id = self.end_id = self.sib_idx = self.end_pos = 0
        self.el_idx = self.type_idx = 1
        self.t0 = self.t1 = t
        self.o0 = self.o1 = self.i0 = self.i1 = o


class _Builder:
    """Builds the elements of one page."""

    def __init__(self, with_html: bool):
        self.nodes: list[_Node] = []
        self.stack: list[_Node] = []
        self.active: list[_Node] = []
        self.text: list[str] = []
        self.t = 0
        self.html: list[str] | None = [] if with_html else None
        self.o = 0
        self.head = self.body = None
        self.root = None
        self.n_listed = 0

    def emit(self, s: str) -> None:
        if self.html is not None:
            self.html.append(s)
            self.o += len(s)

    def push(self, tag: str, attrs: dict[str, str], void: bool = False) -> _Node:
        while len(self.stack) >= MAX_DEPTH:
            self.pop()
        parent = self.stack[-1] if self.stack else None
        node = _Node(len(self.nodes) + 1, tag, attrs, parent, self.t, self.o)
        if parent is None:
            node.path = [0]
        else:
            parent.n_kids += 1
            node.el_idx = parent.n_kids
            node.type_idx = parent.kids[tag] = parent.kids.get(tag, 0) + 1
            node.path = [*parent.path, parent.pos]
        if tag not in _UNLISTED and (parent is None or parent.node_id > 0):
            self.n_listed += 1
            node.node_id = self.n_listed
            if parent is not None:
                node.sib_idx = parent.n_listed
                parent.n_listed += 1
                first = attrs["class"].split(None, 1) if "class" in attrs else None
                parent.labels.append(f"{tag}.{first[0]}" if first else tag)
        self.nodes.append(node)
        if self.html is not None:
            pairs = "".join(f' {k}="{_escape(v, True)}"' for k, v in attrs.items())
            self.emit(f"<{tag}{pairs}/>" if void else f"<{tag}{pairs}>")
        node.i0 = self.o
        if void:
            self.close(node, void=True)
        else:
            self.stack.append(node)
        return node

    def close(self, node: _Node, void: bool = False) -> None:
        node.end_pos, node.end_id = len(self.nodes), self.n_listed
        node.t1, node.i1 = self.t, self.o
        if not void:
            self.emit(f"</{node.tag}>")
        node.o1 = self.o

    def pop(self) -> _Node:
        node = self.stack.pop()
        self.close(node)
        return node

    def pop_to(self, node: _Node) -> None:
        while self.pop() is not node:
            pass

    def find(self, tags, edge=_SCOPE_EDGE) -> _Node | None:
        for node in reversed(self.stack):
            if node.tag in tags:
                return node
            if node.tag in edge:
                return None
        return None

    def add_text(self, s: str, raw: bool = False) -> None:
        self.stack[-1].own.append(s)
        self.text.append(s)
        self.t += len(s)
        self.emit(s if raw else _escape(s))

    def ensure_head(self) -> None:
        if self.root is None:
            self.root = self.push("html", {})
        if self.head is None:
            self.head = self.push("head", {})

    def ensure_body(self, attrs: dict[str, str] | None = None) -> None:
        if self.body is None:
            self.ensure_head()
            while self.stack[-1] is not self.root:
                self.pop()
            self.body = self.push("body", attrs or {})

    def reopen_formatting(self) -> None:
        if not self.active:
            return
        open_ids = {id(n) for n in self.stack}
        first = len(self.active)
        while first and id(self.active[first - 1]) not in open_ids:
            first -= 1
        for i in range(first, len(self.active)):
            old = self.active[i]
            self.active[i] = self.push(old.tag, dict(old.attrs))

    def close_p(self) -> None:
        p = self.find({"p"}, _SCOPE_EDGE | {"button"})
        if p is not None:
            self.pop_to(p)

    def close_item(self, tags) -> None:
        for node in reversed(self.stack):
            if node.tag in tags:
                self.pop_to(node)
                return
            if node.tag in _SPECIAL and node.tag not in ("address", "div", "p"):
                return

    def close_cells(self, tags) -> None:
        node = self.find(tags, {"table", "html", "template"})
        if node is not None:
            self.pop_to(node)

    def start(self, tag: str, attrs: dict[str, str], self_closed: bool) -> bool:
        """Handle a start tag; True when its content is raw text."""
        if tag == "html":
            if self.root is None:
                self.root = self.push("html", attrs)
            else:
                for k, v in attrs.items():
                    self.root.attrs.setdefault(k, v)
            return False
        if tag == "head":
            if self.head is None and self.body is None:
                self.ensure_head()
                self.head.attrs.update(attrs)
            return False
        if tag == "body":
            if self.body is None:
                self.ensure_body(attrs)
            else:
                for k, v in attrs.items():
                    self.body.attrs.setdefault(k, v)
            return False
        if self.body is None:
            if tag in _HEAD:
                self.ensure_head()
                if self.stack[-1] is self.root:
                    self.stack.append(self.head)  # late head content goes into the head
            else:
                self.ensure_body()
        in_body = self.body is not None
        foreign = in_body and any(n.tag in ("svg", "math") for n in self.stack)
        if in_body and not foreign:
            if tag in _CLOSES_P:
                if tag == "li":
                    self.close_item({"li"})
                elif tag in ("dd", "dt"):
                    self.close_item({"dd", "dt"})
                self.close_p()
                if tag in _HEADINGS and self.stack[-1].tag in _HEADINGS:
                    self.pop()
            elif tag in _TABLE_PARTS:
                self.open_table_part(tag)
            elif tag in ("option", "optgroup"):
                if self.stack[-1].tag == "option":
                    self.pop()
                if tag == "optgroup" and self.stack[-1].tag == "optgroup":
                    self.pop()
            elif tag not in _HEAD:
                if tag == "a":
                    self.end_formatting("a")
                self.reopen_formatting()
        void = tag in _VOID or (foreign and self_closed)
        node = self.push(tag, attrs, void)
        if tag in _FORMATTING and in_body and not foreign:
            self.remember(node)
        return not foreign and (tag in _RAW or tag in _ESCAPABLE_RAW)

    def remember(self, node: _Node) -> None:
        twins = [n for n in self.active if n.tag == node.tag and n.attrs == node.attrs]
        if len(twins) >= 3:
            self.active = [n for n in self.active if n is not twins[0]]
        self.active.append(node)

    def open_table_part(self, tag: str) -> None:
        if tag in ("td", "th"):
            self.close_cells({"td", "th"})
            if self.stack[-1].tag == "table":
                self.push("tbody", {})
            if self.stack[-1].tag in ("tbody", "thead", "tfoot"):
                self.push("tr", {})
        elif tag == "tr":
            self.close_cells({"tr"})
            if self.stack[-1].tag == "table":
                self.push("tbody", {})
        elif tag in ("tbody", "thead", "tfoot"):
            self.close_cells({"tbody", "thead", "tfoot"})

    def end_formatting(self, tag: str) -> bool:
        for node in reversed(self.active):
            if node.tag == tag:
                self.active = [n for n in self.active if n is not node]
                for k in range(len(self.stack) - 1, -1, -1):
                    if self.stack[k] is node:
                        if not any(n.tag in _SPECIAL for n in self.stack[k + 1 :]):
                            self.pop_to(node)
                        return True
                return True
        return False

    def end(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        if self.body is None:
            if tag == "head":
                self.ensure_head()
                while self.stack[-1] is not self.root:
                    self.pop()
                return
            if tag not in ("br", "p"):
                return
            self.ensure_body()
        if tag == "br":
            self.start("br", {}, False)
        elif tag == "p":
            if self.find({"p"}, _SCOPE_EDGE | {"button"}) is None:
                self.push("p", {})
            self.close_p()
        elif tag in _HEADINGS:
            node = self.find(_HEADINGS)
            if node is not None:
                self.pop_to(node)
        elif tag in _FORMATTING and self.end_formatting(tag):
            return
        elif tag in _TABLE_PARTS or tag == "table":
            node = self.find({tag}, {"html", "template"} if tag == "table" else {"table", "html", "template"})
            if node is not None:
                self.pop_to(node)
        elif tag in _CLOSES_P or tag == "button":
            node = self.find({tag})
            if node is not None:
                self.pop_to(node)
        else:
            for node in reversed(self.stack):
                if node.tag == tag:
                    self.pop_to(node)
                    break
                if node.tag in _SPECIAL:
                    break

    def feed(self, source: str) -> None:
        at, n = 0, len(source)
        scan = _TOKEN.search
        while at < n:
            m = scan(source, at)
            if m is None:
                self.chars(source[at:])
                break
            if m.start() > at:
                self.chars(source[at : m.start()])
            at = m.end()
            kind = m.lastgroup
            if kind == "close":
                self.end(m["close"].lower())
            elif kind == "attrs":
                tag, blob = m["open"].lower(), m["attrs"]
                attrs: dict[str, str] = {}
                if blob:
                    for k, a, b, c in _ATTR.findall(blob):
                        v = a or b or c
                        attrs.setdefault(k.lower(), _unescape_attr(v) if "&" in v else v)
                if self.start(tag, attrs, blob.endswith("/")):
                    stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(source, at)
                    end = stop.start() if stop else n
                    body = source[at:end]
                    if body:
                        raw = tag in _RAW
                        self.add_text(body if raw else unescape(body), raw)
                    close = source.find(">", end)
                    at = n if close < 0 else close + 1
                    self.pop()
                    if self.body is None and self.stack and self.stack[-1] is self.head and self.head.end_pos:
                        self.stack.pop()
                        self.head.end_pos = len(self.nodes)
                        self.head.end_id = self.n_listed
                        self.head.t1, self.head.i1, self.head.o1 = self.t, self.o, self.o
            elif kind == "comment":
                self.emit(f"<!--{m['comment']}-->")
            elif kind == "decl" and self.root is None and self.html is not None:
                self.emit(f"<!{m['decl']}>" if m["decl"][:7].lower() == "doctype" else "")
        self.ensure_body()
        while self.stack:
            self.pop()

    def chars(self, s: str) -> None:
        if "&" in s:
            s = unescape(s)
        if self.body is None:
            blank = not s.strip("\t\n\f\r ")
            if blank and (self.root is None or self.head is None):
                return
            if not blank:
                lead = s[: len(s) - len(s.lstrip("\t\n\f\r "))]
                if lead and self.head is not None:
                    self.add_text(lead)
                s = s[len(lead) :]
                self.ensure_body()
        if self.body is not None:
            self.reopen_formatting()
        self.add_text(s)


def _squeeze(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


_COPIED = (
    "pos", "end_pos", "el_idx", "type_idx", "node_id", "end_id", "sib_idx", "tag", "path",
    "t0", "t1", "o0", "o1", "i0", "i1",
)


def _add_columns(fields: dict[str, list], nodes: list[_Node]) -> None:
    for k in _COPIED:
        fields[k] += map(attrgetter(k), nodes)
    parents = [n.parent for n in nodes]
    fields["parent_pos"] += [p.pos if p else 0 for p in parents]
    fields["parent_id"] += [p.node_id if p else 0 for p in parents]
    fields["n_el"] += [p.n_kids if p else 1 for p in parents]
    fields["n_type"] += [p.kids[n.tag] if p else 1 for n, p in zip(nodes, parents, strict=True)]
    fields["depth"] += [len(n.path) - 1 for n in nodes]
    fields["id_attr"] += [n.attrs.get("id", "") for n in nodes]
    fields["classes"] += [list(dict.fromkeys(n.attrs["class"].split())) if "class" in n.attrs else [] for n in nodes]
    fields["attrs"] += [list(n.attrs.items()) for n in nodes]
    fields["child_sig"] += [",".join(n.labels) for n in nodes]
    fields["own_text"] += [_squeeze(n.own) if n.own else "" for n in nodes]


def shred_batch(pages: list[str | None], with_html: bool) -> pa.StructArray:
    """Elements, text and (optionally) normalised source of a batch of pages as one Arrow column."""
    fields: dict[str, list] = {f.name: [] for f in NODE}
    starts, texts, sources = [0], [], []
    collecting = gc.isenabled()
    gc.disable()  # the nodes of a page refer to each other; they are freed page by page below
    try:
        for source in pages:
            b = _Builder(with_html)
            b.feed(source or "")
            _add_columns(fields, b.nodes)
            starts.append(starts[-1] + len(b.nodes))
            texts.append("".join(b.text))
            sources.append("".join(b.html) if b.html is not None else "")
            for n in b.nodes:
                n.parent = None
    finally:
        if collecting:
            gc.enable()
    rows = pa.StructArray.from_arrays([pa.array(fields[f.name], type=f.type) for f in NODE], fields=list(NODE))
    return pa.StructArray.from_arrays(
        [
            pa.ListArray.from_arrays(pa.array(starts, pa.int32()), rows),
            pa.array(texts, pa.string()),
            pa.array(sources, pa.string()),
        ],
        fields=list(PAGE),
    )


def page_runs(html: pa.Array, most: int = RUN_BYTES) -> Iterator[pa.Array]:
    """Slices of a batch of about ``most`` bytes of source, one page at least.

    How many pages Spark puts into a batch is the session's business; the elements of a page take some fifty times
    its bytes while they are Python objects, so a batch is not taken apart as a whole.
    """
    at, room = 0, 0
    for i, size in enumerate(pc.binary_length(html).to_pylist()):
        if i > at and room + (size or 0) > most:
            yield html.slice(at, i - at)
            at, room = i, 0
        room += size or 0
    if at < len(html):
        yield html.slice(at)


def _shred_runs(batches: Iterator[pa.Array], with_html: bool) -> Iterator[pa.Array]:
    for html in batches:
        for run in page_runs(html):
            yield shred_batch(run.to_pylist(), with_html)


@F.arrow_udf(PAGE_TYPE)
def _shred(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    return _shred_runs(batches, False)


@F.arrow_udf(PAGE_TYPE)
def _shred_with_html(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    return _shred_runs(batches, True)


# Declared nondeterministic so that the optimizer neither repeats the parse nor pushes a filter on its
# result below it: it would otherwise parse every page twice for an exploded column.
PARSERS = {False: _shred.asNondeterministic(), True: _shred_with_html.asNondeterministic()}


def shred(html: Column, with_html: bool = False) -> Column:
    """STRUCT<nodes, text, html> of a page; ``html`` is filled only on request."""
    return PARSERS[with_html](html)
