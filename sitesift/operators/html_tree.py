"""A small tolerant HTML tree and a CSS-subset matcher.

This is the per-page helper that runs inside the ``mapInPandas`` extraction
tasks (X3, X5, X9); Spark partitions the pages, this only turns one page into
nodes. It sits on the standard library's ``html.parser`` (entities decoded,
``script``/``style`` kept as raw text) and has two tree modes:

* ``static`` - what a lenient parser without HTML5 rules builds: an end tag
  closes the nearest open element of that name, nothing is closed implicitly.
  An unclosed ``<p>`` therefore holds everything after it.
* ``dom`` - what a browser builds for the common cases: a new ``p`` or block
  element closes an open ``p``; ``li``, ``dt``/``dd``, ``option``, ``tr``,
  ``td``/``th`` close their open siblings. (Formatting-element reconstruction
  is not modelled; it changes no text.)

Selectors: type, ``*``, ``.class``, ``#id``, ``[attr]``, ``[attr=v]``,
``[attr*=v]``, ``[attr^=v]``, ``[attr$=v]``, ``[attr~=v]``, descendant and
child (``>``) combinators, comma lists.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape
from html.entities import html5 as _HTML5
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input keygen link meta param source track wbr".split())
RAW_TEXT = frozenset(("script", "style"))
# Start tags that close an open <p> in a browser.
P_CLOSERS = frozenset(
    "address article aside blockquote details dialog div dl fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SCOPE_BARRIERS = frozenset("html table td th caption button object template marquee applet".split())


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict, parent: "Node | None"):
        self.tag = tag
        self.attrs = attrs
        self.children: list = []
        self.parent = parent

    def iter(self):
        """Descendant elements in document order (self excluded)."""
        stack = [iter(self.children)]
        while stack:
            for ch in stack[-1]:
                if isinstance(ch, Node):
                    yield ch
                    stack.append(iter(ch.children))
                    break
            else:
                stack.pop()

    def strings(self):
        """(text, kind) of every text descendant in document order."""
        stack = [iter(self.children)]
        while stack:
            for ch in stack[-1]:
                if isinstance(ch, Node):
                    stack.append(iter(ch.children))
                    break
                yield ch
            else:
                stack.pop()


class _Builder(HTMLParser):
    def __init__(self, dom: bool):
        # dom: references decoded as a browser does (html.unescape); static:
        # reported one by one below, as the lenient parser does
        super().__init__(convert_charrefs=dom)
        self.dom = dom
        self.root = Node("#document", {}, None)
        self.stack = [self.root]

    # -- tree building -------------------------------------------------
    def _close_in_scope(self, tags, barriers=SCOPE_BARRIERS):
        for i in range(len(self.stack) - 1, 0, -1):
            t = self.stack[i].tag
            if t in tags:
                del self.stack[i:]
                return
            if t in barriers:
                return

    def _implied_end(self, tag):
        if tag in P_CLOSERS:
            self._close_in_scope(("p",))
        if tag == "li":
            self._close_in_scope(("li",), SCOPE_BARRIERS | {"ul", "ol"})
        elif tag in ("dt", "dd"):
            self._close_in_scope(("dt", "dd"), SCOPE_BARRIERS | {"dl"})
        elif tag in ("option", "optgroup"):
            self._close_in_scope(("option",), SCOPE_BARRIERS | {"select"})
        elif tag == "tr":
            self._close_in_scope(("tr",), {"table", "html"})
        elif tag in ("td", "th"):
            self._close_in_scope(("td", "th"), {"tr", "table", "html"})
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6") and self.stack[-1].tag in (
                "h1", "h2", "h3", "h4", "h5", "h6"):
            self.stack.pop()

    def handle_starttag(self, tag, attrs):
        if self.dom:
            self._implied_end(tag)
        amap = {}
        for k, v in attrs:
            # a repeated attribute: browsers keep the first, the lenient
            # static parser the last
            if not (self.dom and k in amap):
                amap[k] = "" if v is None else v
        parent = self.stack[-1]
        node = Node(tag, amap, parent)
        parent.children.append(node)
        if tag not in VOID:
            self.stack.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._pop_to(tag)

    def handle_endtag(self, tag):
        if tag not in VOID:
            self._pop_to(tag)

    def _pop_to(self, tag):
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                return

    def handle_data(self, data):
        kind = "raw" if self.stack[-1].tag in RAW_TEXT else "text"
        kids = self.stack[-1].children
        if kids and isinstance(kids[-1], tuple) and kids[-1][1] == kind:
            kids[-1] = (kids[-1][0] + data, kind)  # one string per run of text
        else:
            kids.append((data, kind))

    def handle_entityref(self, name):
        # static mode only: a known name is decoded (with or without ';'),
        # an unknown one stays as written, without its ';'
        ch = _HTML5.get(name + ";") or _HTML5.get(name)
        self.handle_data(ch if ch is not None else "&" + name)

    def handle_charref(self, name):
        self.handle_data(unescape(f"&#{name};"))

    def handle_comment(self, data):
        self.stack[-1].children.append((data, "comment"))


def parse(html: str | None, mode: str = "static") -> Node:
    b = _Builder(dom=(mode == "dom"))
    try:
        b.feed(html or "")
        b.close()
    except Exception:  # a broken tail keeps what was built so far
        pass
    return b.root


# -- text ----------------------------------------------------------------
_JS_WS = re.compile(r"[\s\ufeff]+")  # JavaScript \s also covers the BOM


def static_text(node: Node) -> str:
    """Each visible text node stripped, empty ones dropped, joined with no
    separator (script, style and comments excluded)."""
    parts = []
    for data, kind in node.strings():
        if kind == "text":
            s = data.strip()
            if s:
                parts.append(s)
    return "".join(parts)


def dom_text(node: Node) -> str:
    """``textContent`` (script/style text included, comments not), trimmed
    and with whitespace runs collapsed."""
    raw = "".join(d for d, kind in node.strings() if kind != "comment")
    return _JS_WS.sub(" ", raw).strip()


# -- selectors -----------------------------------------------------------
_TOKEN = re.compile(r"""
    \s*(?P<child>>)\s*
  | (?P<ws>\s+)
  | (?P<tag>\*|[A-Za-z][A-Za-z0-9_-]*)
  | \.(?P<cls>[A-Za-z0-9_-]+)
  | \#(?P<id>[A-Za-z0-9_-]+)
  | \[\s*(?P<attr>[A-Za-z0-9_:-]+)\s*
       (?:(?P<op>[*^$~|]?=)\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<bare>[^\]\s]+))\s*)?\]
""", re.X)


def _split_commas(text: str) -> list[str]:
    parts, depth, quote, cur = [], 0, None, []
    for ch in text:
        if quote:
            quote = None if ch == quote else quote
        elif ch in "\"'":
            quote = ch
        elif ch == "[":
            depth += 1
        elif ch == "]":
            depth -= 1
        elif ch == "," and depth == 0:
            parts.append("".join(cur))
            cur = []
            continue
        cur.append(ch)
    parts.append("".join(cur))
    return [p.strip() for p in parts if p.strip()]


@lru_cache(maxsize=4096)
def compile_one(selector: str):
    """One complex selector -> tuple of (combinator, tag, conditions)."""
    parts, tag, conds, comb = [], None, [], None
    pos, text = 0, selector.strip()

    def flush():
        nonlocal tag, conds
        if tag is None and not conds:
            return False
        parts.append((comb, tag, tuple(conds)))
        tag, conds = None, []
        return True

    while pos < len(text):
        m = _TOKEN.match(text, pos)
        if not m or m.end() == pos:
            raise ValueError(f"unsupported selector: {selector!r}")
        pos = m.end()
        if m.group("child") or m.group("ws"):
            if flush():
                comb = ">" if m.group("child") else " "
            elif m.group("child"):
                comb = ">"
            continue
        if m.group("tag"):
            tag = None if m.group("tag") == "*" else m.group("tag").lower()
            if m.group("tag") == "*":
                conds.append(("any", None, None))
        elif m.group("cls"):
            conds.append(("~=", "class", m.group("cls")))
        elif m.group("id"):
            conds.append(("=", "id", m.group("id")))
        else:
            val = next((v for v in (m.group("dq"), m.group("sq"), m.group("bare")) if v is not None), None)
            conds.append((m.group("op") or "has", m.group("attr").lower(), val))
    flush()
    return tuple(parts)


@lru_cache(maxsize=4096)
def compile_list(selector: str):
    """A comma list -> tuple of compiled complex selectors."""
    return tuple(compile_one(p) for p in _split_commas(selector))


def _cond(node: Node, op, name, val) -> bool:
    if op == "any":
        return True
    have = node.attrs.get(name)
    if have is None:
        return False
    if op == "has":
        return True
    if op == "=":
        return have == val
    if op == "~=":
        return val in have.split()
    if op == "*=":
        return bool(val) and val in have
    if op == "^=":
        return bool(val) and have.startswith(val)
    if op == "$=":
        return bool(val) and have.endswith(val)
    if op == "|=":
        return have == val or have.startswith(val + "-")
    return False


def _compound(node: Node, tag, conds) -> bool:
    if tag is not None and node.tag != tag:
        return False
    return all(_cond(node, *c) for c in conds)


def _match(node: Node, parts, i: int) -> bool:
    comb, tag, conds = parts[i]
    if not _compound(node, tag, conds):
        return False
    if i == 0:
        return True
    p = node.parent
    if comb == ">":
        return p is not None and p.tag != "#document" and _match(p, parts, i - 1)
    while p is not None and p.tag != "#document":
        if _match(p, parts, i - 1):
            return True
        p = p.parent
    return False


def matches(node: Node, compiled) -> bool:
    return any(_match(node, parts, len(parts) - 1) for parts in compiled)


def select(scope: Node, selector: str) -> list[Node]:
    """All descendants of ``scope`` matching the comma list, document order."""
    compiled = compile_list(selector)
    return [n for n in scope.iter() if matches(n, compiled)]


def select_one(scope: Node, selector: str) -> Node | None:
    compiled = compile_list(selector)
    for n in scope.iter():
        if matches(n, compiled):
            return n
    return None


def split_selector(selector: str | None) -> list[str]:
    return _split_commas(selector) if selector else []
