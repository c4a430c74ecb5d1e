"""Main text of web pages by boosted trees over the nodes of the page (operator 9).

A page is read once into block nodes with their text, in linear time whatever the markup.
Every node has features: density of text and links in its subtree, tokens of its class, id
and role and of those above it, depth, its place and how it compares with its siblings. A
gradient-boosted tree classifier tells how likely the node belongs to the main text. It is
trained on a bounded sample of pages whose own markup labels them: what lies in an article or
main element belongs, what lies in navigation, headers, footers, sidebars, forms, or in blocks
named as adverts, notices or comments does not. A name counts by its first or last part, never on
a paragraph, heading or body, and never on what holds an article or nearly all text of the page.

Choices are then made for the whole tree: a dropped node drops all that is below it, and the
most likely choice of that kind is found from the leaves up. So no kept paragraph can lie in
a dropped block.

Scripts, styles, templates, the head and comments are never text. White space within a block is
one blank, blocks are joined by a blank. Null html counts as empty and gives ''. Rows that
repeat a key or page, null keys and urls, and other columns change nothing. Without labelled
nodes of both kinds, the names of elements and blocks decide alone.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.common import sampled, slices
from broadsheet.session import stored

SAMPLE_PAGES = 400
ROUNDS = 10
DEPTH = 4

# Elements as HTML defines them.
_VOID = set("area base br col embed hr img input link meta source track wbr".split())
_RAW = set("script style noscript template title textarea iframe svg".split())
_INLINE = set(
    "a abbr acronym b bdi bdo big cite code data dfn em font i ins del kbd label mark q s samp small "
    "span strike strong sub sup time tt u var".split()
)
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
# Elements that say what they hold.
_MAIN = {"article", "main"}
_ASIDE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select"}
# Tokens of class, id and role that say what a block holds.
_GOOD_TOKENS = set("article articlebody content entry main post story text body".split())
_BAD_TOKENS = set(
    "ad ads advert advertisement banner breadcrumb breadcrumbs comment comments cookie consent disqus "
    "footer form header login menu modal nav navbar navigation newsletter notice popup promo related "
    "replies respond share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
# First parts that tell of a state of the page, such as "has-sidebar".
_STATES = set("has have is no not with without show hide open closed wp js".split())
_NEVER_ASIDE = {"#root", "html", "body", "p", "h1", "h2", "h3", "h4", "h5", "h6"}
_TAGS = ["p", "div", "section", "article", "main", "ul", "ol", "li", "table", "td", "blockquote", "pre", "figure", *sorted(_ASIDE)]
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_TOKEN = re.compile(r"[A-Za-z]+")
# Attributes up to the end of the tag: a quote opens a value only right after =, and anywhere else
# is part of a name. No step goes back, so any markup takes linear time.
_TAG_REST = re.compile(
    r"""(?:[\s/]*+[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]*+))?+)*+[\s/]*+>"""
)


def names_aside(parts: list[str]) -> bool:
    """Whether a word of a class, id or role, in its parts, names an aside. The first part or
    the last one does; a state of the page does not, nor the header of an article."""
    if not parts or parts[0] in _STATES:
        return False
    of_article = parts[-1] == "header" and parts[0] in _GOOD_TOKENS
    return parts[0] in _BAD_TOKENS or parts[-1] in _BAD_TOKENS and not of_article


class Page:
    """The block nodes of a page, parents before children, and its text in order."""

    def __init__(self, html: str):
        self.tags = ["#root"]
        self.parents = [0]
        self.names: list[frozenset[str]] = [frozenset()]
        self.asides = [0]  # words of class, id and role that name an aside, by node
        self.links = [0]  # characters inside links, by node
        self.own = [0]  # characters of text, by node
        self.marks = [0]  # full stops and commas, by node
        self.parts: list[tuple[int, bool, str]] = []  # node, whether a block starts here, text
        self._read(html)

    def _tag_end(self, html: str, start: int) -> int:
        """Just after the > that ends a tag, which may not be within a quoted value; -1 without
        one. A value whose quote is never closed ends like one without quotes."""
        found = _TAG_REST.match(html, start)
        return found.end() if found else -1

    def _read(self, html: str) -> None:
        stack: list[tuple[str, int]] = [("#root", 0)]  # open elements with their block node
        blocks = ["#root"]  # those that are neither inline nor paragraphs
        counts: dict[str, int] = {}
        links, fresh, at, size = 0, True, 0, len(html)

        def text(run: str) -> None:
            nonlocal fresh
            if not run:
                return
            run = entities.unescape(run)
            node = stack[-1][1]
            n = len(run) if not run.isspace() else 0
            if n:
                self.own[node] += n
                self.marks[node] += run.count(".") + run.count(",")
                if links:
                    self.links[node] += n
            self.parts.append((node, fresh, run))
            fresh = False

        def close(name: str) -> None:
            nonlocal links, fresh
            while True:
                top, _ = stack.pop()
                counts[top] -= 1
                links -= top == "a"
                fresh = fresh or top not in _INLINE
                if top not in _INLINE and top != "p":
                    blocks.pop()
                if top == name:
                    return

        while at < size:
            begin = html.find("<", at)
            if begin < 0:
                text(html[at:])
                break
            text(html[at:begin])
            if html.startswith("<!--", begin):
                end = html.find("-->", begin + 4)
                at = size if end < 0 else end + 3
                continue
            closing = html.startswith("</", begin)
            name = _NAME.match(html, begin + (2 if closing else 1))
            if not name:
                if html[begin + 1 : begin + 2] in ("!", "?", "/"):
                    end = html.find(">", begin)
                    at = size if end < 0 else end + 1
                else:
                    text("<")
                    at = begin + 1
                continue
            end = self._tag_end(html, name.end())
            at = size if end < 0 else end
            tag = name[0].lower()
            if closing:
                if tag == "p" and not counts.get("p"):
                    fresh = True
                if counts.get(tag):
                    close(tag)
                continue
            if tag in _VOID:
                fresh = fresh or tag in ("br", "hr")
                continue
            if tag == "svg" and html[at - 2 : at] == "/>":
                continue
            if tag in _RAW or tag == "head":
                # Raw text ends at its own end tag; a head also where the body starts.
                found = re.compile(rf"</{tag}\s*>" if tag != "head" else r"</head\s*>|(?=<body\b)", re.I).search(html, at)
                if found:
                    at = found.end()
                elif tag != "head":
                    at = size
                fresh = fresh or tag not in ("svg", "script")
                continue
            if html[at - 2 : at] == "/>":
                continue
            if tag in _INLINE:
                stack.append((tag, stack[-1][1]))
                counts[tag] = counts.get(tag, 0) + 1
                links += tag == "a"
                continue
            fresh = True
            if counts.get("p"):
                close("p")
            for other in _CLOSED_BY.get(tag, ()):
                # Only within the list or table at hand.
                if blocks[-1] == other:
                    close(other)
            attributes = _ATTRIBUTE.findall(html[name.end() : at])
            words = [[t.lower() for t in _TOKEN.findall(w)] for a in attributes for v in a[1:] for w in v.split()]
            self.tags.append(tag)
            self.parents.append(stack[-1][1])
            self.names.append(frozenset(t for parts in words for t in parts))
            self.asides.append(0 if tag in _NEVER_ASIDE else sum(map(names_aside, words)))
            if tag != "p":
                blocks.append(tag)
            for numbers in (self.links, self.own, self.marks):
                numbers.append(0)
            stack.append((tag, len(self.tags) - 1))
            counts[tag] = counts.get(tag, 0) + 1

    def describe(self) -> tuple[np.ndarray, list[int | None]]:
        """The features of every node, and what the page's own names say of it: 1 belongs,
        0 does not, None not told."""
        n = len(self.tags)
        text, links, marks = self.own[:], self.links[:], self.marks[:]
        below, children, largest = [1] * n, [0] * n, [0] * n
        for i in range(n - 1, 0, -1):
            up = self.parents[i]
            children[up] += 1
            for numbers in (text, links, marks, below):
                numbers[up] += numbers[i]
            largest[up] = max(largest[up], text[i])
        # What holds an article, or nearly all text, is no aside whatever it is named.
        asides = self.asides[:]
        holds = [tag in _MAIN and not bad for tag, bad in zip(self.tags, asides)]
        for i in range(n - 1, 0, -1):
            holds[self.parents[i]] = holds[self.parents[i]] or holds[i]
            if asides[i] and (holds[i] or text[i] > 0.9 * text[0]):
                asides[i] = 0
        depth, seen = [0] * n, [0] * n
        aside, main, bad_above, good_above = [False] * n, [False] * n, [0] * n, [0] * n
        alike: dict[tuple[int, str], int] = {}
        for i in range(1, n):
            key = (self.parents[i], self.tags[i])
            alike[key] = alike.get(key, 0) + 1
        rows = []
        whole = max(1, text[0])
        order = 0
        for i in range(n):
            up, tag, names = self.parents[i], self.tags[i], self.names[i]
            bad, good = asides[i], len(names & _GOOD_TOKENS)
            if i:
                depth[i] = depth[up] + 1
                bad_above[i] = bad_above[up] + asides[up]
                good_above[i] = good_above[up] + len(self.names[up] & _GOOD_TOKENS)
                seen[up] += 1
            aside[i] = (i > 0 and aside[up]) or tag in _ASIDE or bad > 0
            main[i] = (i > 0 and main[up]) or tag in _MAIN or "articlebody" in names
            rows.append(
                [
                    depth[i],
                    children[i],
                    math.log1p(self.own[i]),
                    math.log1p(text[i]),
                    text[i] / below[i] / 100,
                    links[i] / max(1, text[i]),
                    marks[i] / max(1, text[i]) * 100,
                    text[i] / whole,
                    order / whole,
                    text[i] / max(1, largest[up]),
                    children[up],
                    seen[up] / max(1, children[up]),
                    alike.get((up, tag), 1) / max(1, children[up]),
                    bad,
                    good,
                    bad_above[i],
                    good_above[i],
                    float(tag in _HEADINGS),
                    *[float(tag == t) for t in _TAGS],
                ]
            )
            order += self.own[i]
        holds = main[:]
        for i in range(n - 1, 0, -1):
            holds[self.parents[i]] = holds[self.parents[i]] or holds[i]
        told = [0 if a else 1 if h else None for a, h in zip(aside, holds)]
        return np.array(rows, np.float64), told

    def text(self, chances: np.ndarray) -> str:
        """The text of the most likely choice in which all below a dropped node is dropped."""
        n = len(self.tags)
        p = np.clip(chances, 1e-6, 1 - 1e-6)
        keep, drop = np.log(p).tolist(), np.log(1 - p).tolist()
        for i in range(n - 1, 0, -1):
            up = self.parents[i]
            keep[up] += max(keep[i], drop[i])
            drop[up] += drop[i]
        kept = [True] * n
        for i in range(1, n):
            kept[i] = kept[self.parents[i]] and keep[i] >= drop[i]
        out = []
        gap = False
        for node, fresh, run in self.parts:
            if kept[node]:
                out.append(" " + run if fresh or gap else run)
                gap = False
            else:
                gap = True
        return " ".join("".join(out).split())


class Trees:
    """Boosted regression trees as arrays: nodes hold feature, threshold, children and value."""

    def __init__(self, model):
        self.trees = []
        for tree, weight in zip(model.trees, model.treeWeights):
            rows: list[list[float]] = []

            def add(node) -> int:
                place = len(rows)
                rows.append([-1, 0.0, 0, 0, node.prediction()])
                if node.subtreeDepth() > 0:
                    split = node.split()
                    left, right = add(node.leftChild()), add(node.rightChild())
                    rows[place][:4] = [split.featureIndex(), split.threshold(), left, right]
                return place

            add(tree._call_java("rootNode"))
            self.trees.append((np.array(rows), float(weight)))

    def chances(self, rows: np.ndarray) -> np.ndarray:
        margin = np.zeros(len(rows))
        for nodes, weight in self.trees:
            at = np.zeros(len(rows), np.int64)
            inner = nodes[at, 0] >= 0
            while inner.any():
                feature = np.maximum(nodes[at, 0].astype(np.int64), 0)
                left = rows[np.arange(len(rows)), feature] <= nodes[at, 1]
                at = np.where(inner, np.where(left, nodes[at, 2], nodes[at, 3]).astype(np.int64), at)
                inner = nodes[at, 0] >= 0
            margin += weight * nodes[at, 4]
        return 1 / (1 + np.exp(-2 * margin))


def fit(
    pages: DataFrame,
    key: str = "page_id",
    html: str = "html",
    sample_pages: int = SAMPLE_PAGES,
    rounds: int = ROUNDS,
    depth: int = DEPTH,
) -> Trees | None:
    """Boosted trees from the labelled nodes of at most `sample_pages` pages."""
    rows = pages.where(F.col(key).isNotNull() & F.col(html).isNotNull()).select(F.col(key).alias("_key"), F.col(html).alias("_html"))
    picked = sampled(rows.select("_key").distinct(), "_key", sample_pages)
    some = rows.join(F.broadcast(picked), "_key").select("_html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_html"):
            for page in batch.column("_html").to_pylist():
                features, told = Page(page).describe()
                known = [i for i, t in enumerate(told) if t is not None]
                labels = [float(told[i]) for i in known]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(labels, pa.float64()), pa.array(list(features[known]), pa.list_(pa.float64()))],
                    names=["label", "features"],
                )

    nodes = stored(some.mapInArrow(run, "label double, features array<double>"), "nodes")
    if nodes.select("label").distinct().count() < 2:
        return None
    learner = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=5)
    return Trees(learner.fit(nodes.select("label", array_to_vector("features").alias("features"))))


def extract(
    pages: DataFrame, model: Trees | None, key: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """(page_id, url, text) of every row."""
    rows = pages.select(
        F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            read = [Page(h) for h in batch.column("html").to_pylist()]
            described = [page.describe() for page in read]
            if model:
                chances = model.chances(np.concatenate([f for f, _ in described]))
            else:
                chances = np.array([0.1 if t == 0 else 0.9 for _, told in described for t in told])
            ends = np.cumsum([len(p.tags) for p in read])
            texts = [page.text(chances[e - len(page.tags) : e]) for page, e in zip(read, ends.tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())],
                names=["page_id", "url", "text"],
            )

    return rows.mapInArrow(run, "page_id bigint, url string, text string")
