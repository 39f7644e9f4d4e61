"""A tolerant HTML tree and the selector subset that extraction uses."""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = {"script": False, "style": False, "noembed": False, "noframes": False, "iframe": False, "title": True, "textarea": True}
#: Opening one of these ends an open paragraph.
BLOCKS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
HEAD = frozenset("base link meta title style script noscript template head".split())
ENDS = {"li": ("li", {"ul", "ol"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr td th", {"table"}), "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}), "option": ("option", {"select"}), "tbody": ("thead tbody tr td th", {"table"})}


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Node | None = None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs or {}, [], parent

    def walk(self) -> Iterator[Node]:
        """Elements below this one in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(c for c in reversed(n.children) if isinstance(c, Node))

    def text(self) -> str:
        out: list[str] = []
        stack: list = [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            else:
                stack.extend(reversed(n.children))
        return "".join(out)

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def find(self, selector: str) -> list[Node]:
        test = compiled(selector)
        return [n for n in self.walk() if test(n)]

    def first(self, selector: str) -> Node | None:
        test = compiled(selector)
        return next((n for n in self.walk() if test(n)), None)

    def matches(self, selector: str) -> bool:
        return compiled(selector)(self)

    def next_element(self) -> Node | None:
        if self.parent is None:
            return None
        own = [c for c in self.parent.children if isinstance(c, Node)]
        at = next(i for i, c in enumerate(own) if c is self)
        return own[at + 1] if at + 1 < len(own) else None


class Listed:
    """The elements of a tree, listed once for many selectors; for as long as the tree doesn't change."""

    def __init__(self, root: Node):
        self.nodes = list(root.walk())

    def find(self, selector: str) -> list[Node]:
        test = compiled(selector)
        return [n for n in self.nodes if test(n)]

    def first(self, selector: str) -> Node | None:
        test = compiled(selector)
        return next((n for n in self.nodes if test(n)), None)


_SIMPLE = re.compile(r"([a-zA-Z][\w-]*|\*)|\.([\w-]+)|#([\w-]+)|\[([\w:-]+)(?:([*^$]?=)['\"]?([^'\"\]]*)['\"]?)?\]")


_TAG, _CLASS = re.compile(r"[a-zA-Z][\w-]*"), re.compile(r"\.([\w-]+)")


@functools.lru_cache(maxsize=256)
def compiled(selector: str):
    """A test of a comma list of compound selectors: tag, class, id, attribute (=, *=, ^=, $=).

    Plain tags and classes are looked up in sets; others are only tried on elements with attributes.
    """
    tags, classes, rest, bare = set(), set(), [], []
    for s in map(str.strip, re.split(r",(?![^\[]*\])", selector)):
        if _TAG.fullmatch(s):
            tags.add(s.lower())
        elif m := _CLASS.fullmatch(s):
            classes.add(m[1])
        elif s == "*":
            bare.append(_compound(s))
        else:
            rest.append(_compound(s))

    def test(n: Node) -> bool:
        if n.tag in tags:
            return True
        if n.attrs:
            if classes and "class" in n.attrs and not classes.isdisjoint(n.classes()):
                return True
            for t in rest:
                if t(n):
                    return True
        return bool(bare)

    return test


def _compound(text: str):
    parts, at = [], 0
    while at < len(text):
        m = _SIMPLE.match(text, at)
        if m is None:
            raise ValueError(f"selector not understood: {text}")
        tag, cls, ident, attr, op, value = m.groups()
        if tag and tag != "*":
            parts.append(lambda n, t=tag.lower(): n.tag == t)
        elif cls:
            parts.append(lambda n, c=cls: c in n.classes())
        elif ident:
            parts.append(lambda n, i=ident: n.attrs.get("id") == i)
        elif attr:
            test = {None: lambda v, w: True, "=": str.__eq__, "*=": lambda v, w: w != "" and w in v, "^=": lambda v, w: w != "" and v.startswith(w), "$=": lambda v, w: w != "" and v.endswith(w)}[op]
            parts.append(lambda n, a=attr.lower(), t=test, w=value or "": a in n.attrs and t(n.attrs[a], w))
        at = m.end()
    return lambda n: all(p(n) for p in parts)


def parse(page: str) -> Node:
    """Document with ``html``, ``head`` and ``body``, whatever the page holds."""
    root = Node("#document")
    top = Node("html", parent=root)
    head, body = Node("head", parent=top), Node("body", parent=top)
    root.children, top.children = [top], [head, body]
    stack: list[Node] = []
    in_body, at, n = False, 0, len(page)

    def here() -> Node:
        return stack[-1] if stack else (body if in_body else head)

    def put(text: str, raw: bool = False) -> None:
        nonlocal in_body
        if not text:
            return
        if not stack and not in_body:
            if not text.strip():
                return
            in_body = True
        here().children.append(text if raw else html.unescape(text))

    def close(k: int) -> None:
        del stack[k:]

    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            put(page[at:])
            break
        put(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag in ("html", "body"):
                continue
            if tag == "head":
                stack.clear()
                in_body = True
                continue
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag == tag:
                    close(k)
                    break
                if stack[k].tag in ("td", "th", "table") and tag not in ("table", "tr", "td", "th", "tbody", "thead", "tfoot"):
                    break
            else:
                if tag == "p":
                    here().children.append(Node("p", parent=here()))
                elif tag == "br":
                    here().children.append(Node("br", parent=here()))
            continue
        attrs: dict[str, str] = {}
        for a in _ATTR.finditer(m[3]):
            attrs.setdefault(a[1].lower(), html.unescape(a[2] or a[3] or a[4] or ""))
        if tag in ("html", "body", "head"):
            target = {"html": top, "body": body, "head": head}[tag]
            for k, v in attrs.items():
                target.attrs.setdefault(k, v)
            if tag == "body":
                stack.clear()
                in_body = True
            continue
        if not in_body and not stack and tag not in HEAD:
            in_body = True
        if tag in BLOCKS:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag == "p":
                    close(k)
                    break
                if stack[k].tag in ("button", "td", "th", "table", "template"):
                    break
        if tag in ENDS:
            what, until = ENDS[tag]
            k = len(stack) - 1
            while k >= 0 and stack[k].tag not in until:
                if stack[k].tag in what.split():
                    close(k)
                k -= 1
        node = Node(tag, attrs, here())
        here().children.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            inner = page[at : end.start() if end else n]
            if inner:
                node.children.append(html.unescape(inner) if RAW[tag] else inner)
            at = (page.find(">", end.start()) + 1 or n) if end else n
            continue
        if not (m[3].endswith("/") and tag in ("svg", "path", "circle")):
            stack.append(node)
    return root
