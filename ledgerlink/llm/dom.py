"""A tolerant reading of HTML into nodes and text runs."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style template noscript svg iframe select textarea button title".split())
RAW = frozenset("script style textarea title noscript iframe".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES = {
    **{tag: frozenset({"p"}) for tag in BLOCK - {"body", "html", "dd", "dt", "li", "td", "th", "tr", "tbody", "thead", "tfoot"}},
    "li": frozenset({"li", "p"}), "dt": frozenset({"dt", "dd", "p"}), "dd": frozenset({"dt", "dd", "p"}), "td": frozenset({"td", "th", "p"}),
    "th": frozenset({"td", "th", "p"}), "tr": frozenset({"tr", "td", "th", "p"}), "option": frozenset({"option"})}
SCOPES = frozenset("article aside body div footer form header html main nav section table ul ol dl td th blockquote figure fieldset".split())
MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)(?P<end>>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    place: int  # among the parent's elements
    attrs: dict[str, str]
    children: list[int] = field(default_factory=list)


@dataclass
class Page:
    """Nodes in page order, the first a root of its own; and runs (node, text, whether in a link),
    where a run of node -1 is a break between blocks. Inline elements belong to the node they
    stand in, unless ``named`` says that their attributes make them parts of their own."""

    nodes: list[Node]
    runs: list[tuple[int, str, bool]]


def parse(source: str, named: Callable[[dict[str, str]], bool] = lambda attrs: False) -> Page:
    """Nodes and visible text of a page; unclosed and stray tags are taken as browsers would.

    The numbers of open elements by tag are kept beside the stack, so a page is read in one pass
    however deep its elements are nested.
    """
    nodes = [Node("", -1, 0, 0, {})]
    runs: list[tuple[int, str, bool]] = []
    stack, at = [("", 0)], 0
    opened: Counter[str] = Counter()

    def close_from(k: int) -> None:
        opened.subtract(tag for tag, _ in stack[k:])
        del stack[k:]

    while at < len(source):
        match = MARKUP.search(source, at)
        start = match.start() if match else len(source)
        if start > at:
            runs.append((stack[-1][1], entities.unescape(source[at:start]), opened["a"] > 0))
        if not match:
            break
        at = match.end()
        tag = (match["tag"] or "").lower()
        if not tag or not match["end"]:
            continue
        if tag in BLOCK or tag == "br":
            runs.append((-1, " ", False))
        if match["close"]:
            for k in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[k][0] == tag:
                    close_from(k)
                    break
                if stack[k][0] in SCOPES and tag not in SCOPES:
                    break
            continue
        if tag in HIDDEN:
            at = _skip(source, at, tag)
            continue
        closes = CLOSES.get(tag, ())
        for k in range(len(stack) - 1, 0, -1) if any(opened[t] for t in closes) else ():
            own = stack[k][0]
            if own in closes:
                close_from(k)
                break
            if own in SCOPES:
                break
        parent = node = stack[-1][1]
        attrs = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(match["attrs"])} if match["attrs"] else {}
        if tag in BLOCK or attrs and named(attrs):
            nodes.append(Node(tag, parent, nodes[parent].depth + 1, len(nodes[parent].children), attrs))
            node = len(nodes) - 1
            nodes[parent].children.append(node)
        if tag not in VOID and not match["attrs"].rstrip().endswith("/"):
            stack.append((tag, node))
            opened[tag] += 1
    return Page(nodes, runs)


def _skip(source: str, at: int, tag: str) -> int:
    """Place after the element of a tag that shows nothing."""
    close = re.compile(rf"</{tag}\s*>", re.I)
    if tag in RAW or tag == "head":
        if tag == "head":  # a head that is never closed ends where the body opens
            close = re.compile(r"</head\s*>|(?=<body[\s>])", re.I)
        found = close.search(source, at)
        return found.end() if found else (at if tag == "head" else len(source))
    depth = 1
    for match in re.compile(rf"<(/?){tag}(?=[\s/>])[^>]*>", re.I).finditer(source, at):
        depth += -1 if match[1] else 1
        if not depth:
            return match.end()
    return at
