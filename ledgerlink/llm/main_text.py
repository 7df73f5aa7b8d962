"""Main text of web pages: gradient-boosted trees over DOM nodes and a hierarchical decoding.

Nodes are block elements, and inline ones that name themselves as something else; other inline
elements belong to their block. Each node is described by its tag, words of its attributes, depth,
text and link density of its subtree, its place among its siblings, and what stands above it. Trees give the odds that a node
belongs to the article. Decoding picks the likeliest choice of nodes in which nothing below a
dropped node is kept, by one pass up and one pass down each page.

No page is labelled, so the trees learn from pages that mark their article (``article``, ``main``):
nodes in it are text, others are not. Variants of these pages, with other tags and attributes for
the same parts and with further menus, sidebars, forms, notices and comments put in, keep the
trees from relying on one marking. They are made from a bounded sample: the ``SAMPLE_PAGES`` pages
with the lowest hash among those of at most ``SAMPLE_CHARS`` characters.

A page is read in one pass up and down, however deep; pages are taken in parts by their length, so a
very long one is alone in memory. A null page is empty; a page without text gives the empty string. Rows with equal ids are read one
by one. If no page of the sample marks an article, all visible text is kept but for what stands in
elements that name themselves as something else.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlink.llm import boosting, dom
from ledgerlink.llm.tables import lowest_hashes

SAMPLE_PAGES = 250
SAMPLE_CHARS = 60_000
VARIANTS = 3
PAGES_AT_ONCE = 64
CHARS_AT_ONCE = 2_000_000
TEXT = "page_id long, url string, text string"
# Tags and attribute words by what they usually stand for.
TAG_GROUPS = [
    "article main", "section", "div", "p", "h1 h2 h3 h4 h5 h6", "ul ol dl menu", "li dt dd", "nav", "header", "footer", "aside",
    "form fieldset input label", "table tr td th tbody thead tfoot", "blockquote q", "pre code", "figure figcaption img", "body html"]
WORD_GROUPS = [
    "content article post entry story text body main page", "nav navigation navbar menu breadcrumb breadcrumbs pagination pager toc tabs topbar",
    "ad ads adv advert advertisement banner sponsor sponsored promo promoted adsense", "sidebar side aside widget rail related recommended recommendations more popular trending",
    "footer foot bottom copyright legal", "header head masthead top logo branding", "comment comments commentlist disqus reply replies respond discussion reader readers",
    "cookie cookies notice consent alert popup modal gdpr overlay warning message privacy", "share social follow twitter facebook", "form search login signup subscribe newsletter register contact"]
MARKS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_TAG = {tag: k for k, group in enumerate(TAG_GROUPS) for tag in group.split()}
_WORD = {word: k for k, group in enumerate(WORD_GROUPS) for word in group.split()}
_ASIDE = frozenset("nav header footer aside form".split())


def marks(attrs: dict[str, str]) -> set[int]:
    """Groups of words in the attributes that name an element's purpose."""
    found = set()
    for name in ("class", "id", "role", "aria-label", "itemprop", "name"):
        if value := attrs.get(name):
            found.update(_WORD[w] for m in MARKS.findall(value) if (w := m.lower()) in _WORD)
    return found


def read(source: str) -> dom.Page:
    return dom.parse(source, lambda attrs: bool(marks(attrs) - {0}))


def _step(value: float, scale: float) -> int:
    return int(min(31, max(0.0, value) * scale))


def describe(page: dom.Page) -> np.ndarray:
    """One row of small integers per node."""
    nodes = page.nodes
    n = len(nodes)
    own, stops = [0] * n, [0] * n
    first = [-1] * n
    seen = 0
    links = [0] * n
    for node, text, linked in page.runs:
        if node >= 0:
            size = len(text) - text.count(" ")
            links[node] += size * linked
            own[node] += size
            stops[node] += text.count(".") + text.count(",")
            if size and first[node] < 0:
                first[node] = seen
            seen += size
    text, tags, paragraphs, items, deep_stops = own[:], [1] * n, [0] * n, [0] * n, stops[:]
    for k in range(n - 1, 0, -1):
        node = nodes[k]
        paragraphs[k] += node.tag == "p"
        items[k] += node.tag == "li"
        up = node.parent
        text[up] += text[k]
        links[up] += links[k]
        tags[up] += tags[k]
        paragraphs[up] += paragraphs[k]
        items[up] += items[k]
        deep_stops[up] += deep_stops[k]
        if first[k] >= 0 and (first[up] < 0 or first[k] < first[up]):
            first[up] = first[k]
    total = max(1, text[0])
    groups = len(WORD_GROUPS)
    out = np.zeros((n, len(TAG_GROUPS) + 2 * groups + 18), np.uint16)
    above: list[tuple[int, int, int]] = [(0, 0, 0)] * n  # word groups, in an article, in an aside part
    for k, node in enumerate(nodes):
        row = out[k]
        words_above, in_article, in_aside = above[node.parent] if k else (0, 0, 0)
        if node.tag in _TAG:
            row[_TAG[node.tag]] = 1
        at = len(TAG_GROUPS)
        here = words_above
        for g in marks(node.attrs) if node.attrs else ():
            row[at + g] = 1
            here |= 1 << g
        for g in range(groups):
            row[at + groups + g] = words_above >> g & 1
        above[k] = here, in_article | (node.tag in ("article", "main")), in_aside | (node.tag in _ASIDE)
        parent = nodes[node.parent] if k else node
        size = max(1, text[k])
        row[at + 2 * groups:] = (
            in_article, in_aside, _step(node.depth, 1), _step(np.log1p(text[k]), 3), _step(links[k] / size, 31), _step(np.log1p(text[k] / tags[k]), 4),
            _step(text[k] / total, 31), _step(max(0, first[k]) / total, 31), _step(paragraphs[k], 2), _step(items[k], 2), _step(node.place, 2),
            _step(len(parent.children), 1), _step(own[k] / size, 31), _step(deep_stops[k] / size, 300), _step(np.log1p(text[node.parent if k else 0]), 3),
            _step(links[node.parent if k else 0] / max(1, text[node.parent if k else 0]), 31), _step(len(node.children), 2), _step(text[k] / max(1, text[node.parent if k else 0]), 31))
    return out


def decode(nodes: list[dom.Node], logits: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The likeliest choice of nodes in which no kept node lies below a dropped one.

    A node counts with the logarithm of its own text, so that containers without text follow what
    is in them.
    """
    keep = -np.logaddexp(0, -logits) * weights
    drop = -np.logaddexp(0, logits) * weights
    kept, dropped = keep.copy(), drop.copy()
    for k in range(len(nodes) - 1, 0, -1):
        kept[nodes[k].parent] += max(kept[k], dropped[k])
        dropped[nodes[k].parent] += dropped[k]
    chosen = np.zeros(len(nodes), bool)
    chosen[0] = True
    for k in range(1, len(nodes)):
        chosen[k] = chosen[nodes[k].parent] and kept[k] > dropped[k]
    return chosen


def text_of(page: dom.Page, chosen: np.ndarray) -> str:
    """Text of the chosen nodes, blocks and runs of white space joined by one space."""
    return " ".join("".join(text for node, text, _ in page.runs if node < 0 or chosen[node]).split())


def own_weights(page: dom.Page) -> np.ndarray:
    own = np.zeros(len(page.nodes))
    for node, text, _ in page.runs:
        if node >= 0:
            own[node] += len(text.strip())
    return 0.05 + np.log1p(own)


def article_nodes(page: dom.Page) -> np.ndarray | None:
    """Nodes of the marked article without the parts in it that are marked as something else;
    None if the page marks none."""
    inside = np.zeros(len(page.nodes), bool)
    for k, node in enumerate(page.nodes):
        if "data-part" in node.attrs:
            inside[k] = node.attrs["data-part"] == "text"
        elif k:
            other = node.tag in ("nav", "footer", "aside", "form") or bool(marks(node.attrs) - {0}) and node.tag not in ("article", "main")
            inside[k] = not other and (inside[node.parent] or node.tag in ("article", "main"))
    return inside if inside.any() else None


# Parts that variants put in: tag, attributes, and whether it holds links, fields or sentences.
PARTS = [
    ("aside", 'class="sidebar"', "links"), ("div", 'id="sidebar"', "links"), ("div", 'class="widget related"', "links"), ("section", 'class="related-posts"', "sentences"),
    ("div", 'class="comments"', "sentences"), ("section", 'id="comments"', "sentences"), ("div", 'class="comment-list"', "sentences"), ("ol", 'class="commentlist"', "items"),
    ("form", 'class="newsletter"', "fields"), ("form", "", "fields"), ("form", 'id="search"', "fields"), ("div", 'class="cookie-notice"', "sentences"),
    ("div", 'class="notice"', "sentences"), ("div", 'id="consent" role="dialog"', "sentences"), ("header", "", "links"), ("header", 'class="site-header"', "sentences"),
    ("div", 'class="header"', "sentences"), ("div", 'class="ad"', "sentences"), ("div", 'class="banner sponsored"', "sentences"), ("div", 'class="breadcrumbs"', "links"),
    ("nav", 'class="pagination"', "links"), ("div", 'class="share social"', "links"), ("aside", "", "sentences"), ("div", 'class="footer"', "sentences"),
    ("footer", 'class="legal"', "sentences"), ("div", 'class="menu"', "links"), ("div", 'class="promo"', "sentences"), ("div", 'role="navigation"', "links")]
ARTICLES = [("article", ""), ("main", ""), ("div", 'class="content"'), ("div", 'class="post-content"'), ("section", 'class="article-body"'), ("div", 'id="main"'), ("div", 'class="entry"'), ("div", "")]


def variant(source: str, rng: np.random.Generator) -> str:
    """A page with its article and menu under other names and with further parts put in."""
    sentences = [s.strip() for s in re.sub(r"<[^>]*>", " ", source).split(".") if len(s.split()) > 3] or ["More text here"]

    def sentence() -> str:
        return sentences[rng.integers(len(sentences))] + "."

    def passage() -> str:
        """One to five sentences, now and then with a link or emphasis in them."""
        text = " ".join(sentence() for _ in range(rng.integers(1, 6)))
        for mark in ('<a href="#">', "<b>", "<em>", '<span class="x">'):
            if rng.random() < 0.2 and len(words := text.split(" ")) > 4:
                at = int(rng.integers(0, len(words) - 2))
                words[at], words[at + 1] = mark + words[at], words[at + 1] + f"</{mark[1:].split()[0].rstrip('>')}>"
                text = " ".join(words)
        return text

    def inner_piece() -> str:
        kind = rng.random()
        if kind < 0.7:
            return f"<p>{passage()}</p>"
        if kind < 0.8:
            return f"<h2>{' '.join(sentence().split()[:6])}</h2>"
        if kind < 0.9:
            return "<ul>" + "".join(f"<li>{passage()}</li>" for _ in range(rng.integers(2, 6))) + "</ul>"
        return f"<blockquote><p>{passage()}</p></blockquote>" if kind < 0.95 else f"<table><tr><td>{sentence()}</td><td>{sentence()}</td></tr></table>"

    def part() -> str:
        tag, attrs, kind = PARTS[rng.integers(len(PARTS))]
        count = int(rng.integers(1, 7))
        if kind == "links":
            body = "<ul>" + "".join(f'<li><a href="#">{" ".join(sentence().split()[:3])}</a></li>' for _ in range(count + 2)) + "</ul>"
        elif kind == "fields":
            body = "".join(f"<label>{sentence().split()[0]}</label><input>" for _ in range(count)) + f"<p>{sentence()}</p>"
        elif kind == "items":
            body = "".join(f"<li><p>{passage()}</p></li>" for _ in range(count))
        else:
            body = "".join(f"<p>{passage()}</p>" for _ in range(count)) if rng.random() < 0.7 else passage()
        return f'<{tag} {attrs} data-part="other">{body}</{tag}>'

    def parts(most: int) -> str:
        return "".join(part() for _ in range(rng.integers(0, most + 1)))

    match = re.search(r"<(article|main)\b[^>]*>(.*?)(?:</\1\s*>|\Z)", source, re.S | re.I)
    if not match:
        return source
    tag, attrs = ARTICLES[rng.integers(len(ARTICLES))]
    inner = match[2] if rng.random() < 0.4 else "".join(inner_piece() for _ in range(rng.integers(1, 9)))
    inner = inner.replace("</p>", f"</p>{part()}", 1) if rng.random() < 0.25 else inner
    inner = inner + part() if rng.random() < 0.2 else inner
    body = f'{parts(2)}<{tag} {attrs} data-part="text">{inner}</{tag}>{parts(3)}'
    if rng.random() < 0.4:
        body = f"<div>{body}</div>"
    return source[:match.start()] + body + source[match.end():]


def train(sources: list[str], seed: int = 17) -> boosting.Boosted | None:
    """Trees from pages that mark their article; None if there are none."""
    rng = np.random.default_rng(seed)
    rows, labels = [], []
    for source in sources:
        for text in [source, *(variant(source, rng) for _ in range(VARIANTS))]:
            page = read(text)
            inside = article_nodes(page)
            if inside is not None:
                has_text = own_weights(page) > 0.06
                rows.append(describe(page)[has_text])
                labels.append(inside[has_text])
    if not rows or not np.concatenate(labels).any():
        return None
    return boosting.fit(np.concatenate(rows), np.concatenate(labels).astype(float))


def _unmarked(page: dom.Page) -> np.ndarray:
    """Odds without trees: against elements that name themselves as something else, and all below."""
    out = np.full(len(page.nodes), 9.0)
    for k, node in enumerate(page.nodes[1:], 1):
        if node.tag in _ASIDE or marks(node.attrs) - {0} or out[node.parent] < 0:
            out[k] = -9.0
    return out


def extract(sources: list[str | None], model: boosting.Boosted | None) -> list[str]:
    """Main text of each page."""
    pages = [read(source or "") for source in sources]
    if model is None:
        logits = np.concatenate([_unmarked(page) for page in pages])
    else:
        logits = model.logits(np.concatenate([describe(page) for page in pages]))
    ends = np.cumsum([len(page.nodes) for page in pages])
    return [text_of(page, decode(page.nodes, own, own_weights(page))) for page, own in zip(pages, np.split(logits, ends[:-1]))]


def _together(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most ``PAGES_AT_ONCE`` pages and about ``CHARS_AT_ONCE`` characters, one
    page at least: their nodes are in memory together."""
    first, size = 0, 0
    for k, length in enumerate(pa.compute.binary_length(batch.column("html")).to_pylist()):
        if k > first and (size + (length or 0) > CHARS_AT_ONCE or k - first == PAGES_AT_ONCE):
            yield batch.slice(first, k - first)
            first, size = k, 0
        size += length or 0
    if batch.num_rows:
        yield batch.slice(first)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url and main text per row of ``pages`` (page_id, url, html)."""
    own = pages.select("page_id", "url", "html")
    rows = lowest_hashes(own.where(F.length("html") <= SAMPLE_CHARS), SAMPLE_PAGES, "pages", "page_id", "html").select("html").collect()
    model = pages.sparkSession.sparkContext.broadcast(train([r["html"] for r in rows]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _together(batch):
                texts = extract(part.column("html").to_pylist(), model.value)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return own.mapInArrow(run, TEXT)
