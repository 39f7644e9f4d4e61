"""Readability-style article detection: paragraphs give points to their ancestors, and the best container wins.

Written from the published description of the method; scores are not bit-exact with any port of it.
"""

from __future__ import annotations

import re

from .dom import Node

UNLIKELY = re.compile(r"ad-break|agegate|banner|breadcrumb|combx|comment|community|cover-wrap|disqus|extra|footer|gdpr|header|legends|menu|pager|pagination|popup|related|remark|replies|rss|shoutbox|sidebar|skyscraper|social|sponsor|supplemental|yom-remote", re.I)
MAYBE = re.compile(r"and|article|body|column|content|main|shadow", re.I)
GOOD = re.compile(r"article|blog|body|content|entry|hentry|h-entry|main|page|post|story|text", re.I)
BAD = re.compile(r"-ad-|banner|combx|comment|com-|contact|foot|footnote|gdpr|hidden|masthead|media|meta|outbrain|promo|related|scroll|share|shopping|shoutbox|sidebar|skyscraper|sponsor|tags|widget", re.I)
BASE = {"div": 5, "article": 5, "section": 3, "pre": 3, "td": 3, "blockquote": 3, "form": -3, "ul": -3, "ol": -3, "dl": -3, "li": -3, "th": -5, **{f"h{i}": -5 for i in range(1, 7)}}
_SPACE = re.compile(r"\s+")


def _name(n: Node) -> str:
    return f"{n.attrs.get('class', '')} {n.attrs.get('id', '')}"


def _weight(n: Node) -> int:
    out = 0
    for key in ("class", "id"):
        value = n.attrs.get(key, "")
        if value:
            out += (25 if GOOD.search(value) else 0) - (25 if BAD.search(value) else 0)
    return out


def _links(n: Node, text: str) -> float:
    return sum(len(_SPACE.sub(" ", a.text()).strip()) for a in n.find("a")) / max(1, len(text))


def article(root: Node) -> Node | None:
    """The element that holds the article, with clutter inside it removed; null if nothing has points."""
    for n in root.find("script, style, noscript, template, nav, aside, footer, form, button, iframe, input, select, textarea"):
        n.remove()
    body = root.first("body")
    for n in list(body.walk()):
        name = _name(n)
        if n.tag not in ("article", "main", "a") and name.strip() and UNLIKELY.search(name) and not MAYBE.search(name):
            n.remove()
    points: dict[int, float] = {}
    nodes: dict[int, Node] = {}
    for p in body.find("p, td, pre, section, h2, h3, h4, h5, h6, div"):
        if p.tag == "div" and any(isinstance(c, Node) and c.tag in ("p", "div", "ul", "ol", "table", "pre", "section", "article", "blockquote") for c in p.children):
            continue
        text = _SPACE.sub(" ", p.text()).strip()
        if len(text) < 25:
            continue
        score = 1 + text.count(",") + 1 + min(len(text) // 100, 3)
        level, up = 0, p.parent
        while up is not None and level < 5 and up.tag != "#document":
            if id(up) not in points:
                points[id(up)], nodes[id(up)] = BASE.get(up.tag, 0) + _weight(up), up
            points[id(up)] += score / (1 if level == 0 else 2 if level == 1 else level * 3)
            level, up = level + 1, up.parent
    best, most = None, 0.0
    for key, n in nodes.items():
        points[key] *= 1 - _links(n, _SPACE.sub(" ", n.text()).strip())
        if points[key] > most and n.tag not in ("html",):
            best, most = n, points[key]
    if best is None:
        return None
    out = Node("div")
    if best.parent is None or best.tag == "body":
        kept = [best]
    else:
        least = max(10.0, most * 0.2)
        kept = []
        for s in [c for c in best.parent.children if isinstance(c, Node)]:
            text = _SPACE.sub(" ", s.text()).strip()
            linked = _links(s, text) if s is not best else 0
            long = s.tag == "p" and ((len(text) > 80 and linked < 0.25) or (0 < len(text) <= 80 and linked == 0 and re.search(r"\.( |$)", text)))
            if s is best or points.get(id(s), 0) >= least or long:
                kept.append(s)
    out.children = kept
    for n in list(out.walk()):
        if n in kept or n.tag not in ("div", "ul", "ol", "table", "fieldset", "section", "header"):
            continue
        text = _SPACE.sub(" ", n.text()).strip()
        if _weight(n) < 0 or (n.tag == "header" and not n.find("p")) or (len(text) < 500 and text.count(",") < 10 and _links(n, text) > 0.5):
            n.remove()
    return out


_BREAKS = frozenset("p div section article h1 h2 h3 h4 h5 h6 li ul ol table tr blockquote pre br header figure dd dt main".split())


def rendered(n: Node) -> str:
    """Text with a line for each block."""
    out: list[str] = []

    def add(x) -> None:
        if isinstance(x, str):
            out.append(_SPACE.sub(" ", x))
            return
        block = x.tag in _BREAKS
        if block:
            out.append("\n")
        for c in x.children:
            add(c)
        if block:
            out.append("\n")

    stack_safe(add, n)
    lines = [re.sub(" +", " ", x).strip() for x in "".join(out).split("\n")]
    return "\n\n".join(x for x in lines if x)


def stack_safe(f, n: Node) -> None:
    """Runs a recursive walk with room for deep trees."""
    import sys

    depth, stack = 0, [(n, 1)]
    while stack:
        x, d = stack.pop()
        depth = max(depth, d)
        stack.extend((c, d + 1) for c in x.children if isinstance(c, Node))
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, 3 * depth + 2000))
    try:
        f(n)
    finally:
        sys.setrecursionlimit(limit)
