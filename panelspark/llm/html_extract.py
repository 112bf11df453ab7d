"""HTML extraction with a tree-structured graphical model.

Each element and each run of text is a node that is content or not.  Nodes have log-linear potentials of their features
(tag, words in class and id, link share, length, punctuation); each edge has a potential of the two labels it joins and
of the child's kind.  Sum-product message passing, upward and then downward, yields the exact marginal of every node;
runs whose marginal is one half or more are the main text.  Potentials are trained on labelled pages by maximum
likelihood: observed minus expected feature counts, the latter from the same marginals.

A batch of pages is one forest: messages of a depth are computed together.  Pages are independent rows, so the job is one
scan without a shuffle.

Edge cases: null and empty html, and pages without content, give an empty text; unclosed, misnested and truncated markup
is repaired as browsers do for the common cases; text outside any markup is one run; very long pages are whole; repeated
rows are extracted each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .html_pages import labelled_pages

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*'|["'])*?)(?:>|\Z)|[^<]+|<""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|data-content)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_WHITE = re.compile(r"\s+")

# Kinds of HTML elements.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title select".split())
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in _RAW}
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var "
                    "math semantics annotation mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle mpadded mphantom menclose msub msup msubsup munder mover "
                    "munderover mmultiscripts mtable mtr mtd svg g text tspan path circle rect line polyline polygon ellipse defs use desc".split())
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}

# Words in class, id and role that name a part of a page.
_PARTS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pager pagination toolbar tabs",
    "head": "header masthead topbar logo", "foot": "footer copyright colophon legal", "side": "sidebar aside widget rail complementary",
    "advert": "ad ads advert advertisement adverts sponsor sponsored promo promotion banner", "notice": "cookie cookies consent notice alert popup modal gdpr",
    "comment": "comment comments disqus replies reply responses discussion", "share": "share sharing social related recommended newsletter subscribe",
    "form": "form search login signup", "content": "content article post entry story body main text", "wrap": "wrapper page container site layout",
}
_PART_OF = {w: part for part, words in _PARTS.items() for w in words.split()}
_TAGS = "p div section article main nav header footer aside form ul ol li table tr td th dl dt dd h1 h2 h3 h4 h5 h6 pre blockquote figure figcaption body html head button fieldset".split()
_FEATURES = {name: k for k, name in enumerate(
    ["bias", "run", "element"] + [f"tag:{t}" for t in [*_TAGS, "other"]] + [f"part:{p}" for p in _PARTS] + [f"run in {t}" for t in [*_TAGS, "other"]]
    + [f"links:{k}" for k in range(4)] + [f"words:{k}" for k in range(8)] + ["stop", "upper", "symbol"])}
_EDGES = ["run", "block", "named part", "content part", "structure"]
_STRUCTURE = frozenset("nav header footer aside form button fieldset".split())


class Page:
    """Nodes of one page: parents before children."""

    def __init__(self, source: str):
        self.parent, self.kind, self.features, self.texts, self.labels = [-1], [4], [[_FEATURES["bias"], _FEATURES["element"], _FEATURES["tag:html"]]], [None], [0]
        stack: list[tuple[str, int, int]] = [("html", 0, 0)]  # tag, node, label below
        pieces: list[str] = []
        linked = [0]
        in_link = 0
        position = 0

        def flush() -> None:
            if not pieces:
                return
            text = _WHITE.sub(" ", "".join(pieces)).strip()
            pieces.clear()
            letters, linked[0] = linked[0], 0
            if not text:
                return
            tag, node, label = stack[-1]
            words = text.count(" ") + 1
            where = tag if tag in _TAGS else "other"
            share = min(1.0, letters / max(1, len(text)))
            found = ["bias", "run", f"run in {where}", f"links:{0 if share == 0 else 1 if share < 0.5 else 2 if share < 0.9 else 3}", f"words:{min(7, words.bit_length() - 1)}"]
            if text[-1] in ".!?…。":
                found.append("stop")
            if text[0].isupper():
                found.append("upper")
            if not text[0].isalnum():
                found.append("symbol")
            self._add(node, 0, [_FEATURES[f] for f in found], text, label)

        while token := _TOKEN.match(source, position):
            position = token.end()
            name = token.group(2)
            if name is None:
                text = token.group()
                if text[0] != "<" or text == "<":
                    text = html.unescape(text)
                    pieces.append(text)
                    if in_link:
                        linked[0] += len(text.strip())
                continue
            name = name.lower()
            if token.group(1):
                if name in _INLINE:
                    in_link -= name == "a" and in_link > 0
                    continue
                if name == "br":
                    pieces.append(" ")
                    continue
                at = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == name), 0)
                if at:
                    flush()
                    in_link = 0
                    del stack[at:]
                continue
            if name in _RAW:
                if not token.group(3).rstrip().endswith("/"):  # its text is no markup: go on at its end tag
                    end = _RAW_END[name].search(source, position)
                    position = end.start() if end else len(source)
                continue
            if name in _INLINE:
                in_link = 1 if name == "a" else in_link
                continue
            if name in _VOID:
                if name == "hr":
                    flush()
                else:
                    pieces.append(" " if name == "br" else "")
                continue
            flush()
            in_link = 0
            if name in _ENDS_P:
                self._close(stack, ("p",), ("td", "th", "li", "div", "article", "section"))
            elif name in _SIBLINGS:
                self._close(stack, _SIBLINGS[name], _SCOPE[name])
            attributes = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(token.group(3) or "")}
            _, node, label = stack[-1]
            if "data-content" in attributes:
                label = int(attributes["data-content"] == "1")
            words = set(re.split(r"[^a-z]+", " ".join(attributes.get(k, "") for k in ("class", "id", "role")).lower()))
            parts = sorted({_PART_OF[w] for w in words if w in _PART_OF})
            found = ["bias", "element", f"tag:{name if name in _TAGS else 'other'}", *(f"part:{p}" for p in parts)]
            named = [p for p in parts if p not in ("content", "wrap")]
            kind = 2 if named else 4 if name in _STRUCTURE else 3 if "content" in parts or name in ("article", "main") else 1
            stack.append((name, self._add(node, kind, [_FEATURES[f] for f in found], None, label), label))
            if name == "body":
                stack[-1] = ("body", stack[-1][1], label)
        flush()

    def _add(self, parent: int, kind: int, features: list[int], text: str | None, label: int) -> int:
        self.parent.append(parent)
        self.kind.append(kind)
        self.features.append(features)
        self.texts.append(text)
        self.labels.append(label)
        return len(self.parent) - 1

    @staticmethod
    def _close(stack: list, tags: tuple, scope: tuple) -> None:
        """Close an open element of these tags, unless one of the scope lies between."""
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in tags:
                del stack[k:]
                return
            if stack[k][0] in scope:
                return


class Forest:
    """The nodes of many pages, and message passing over all of them, one depth at a time."""

    def __init__(self, pages: list[Page]):
        sizes = np.array([len(p.parent) for p in pages], np.int64)
        start = np.cumsum(sizes) - sizes
        self.page = np.repeat(np.arange(len(pages)), sizes)
        self.parent = np.concatenate([np.array(p.parent, np.int64) + s * (np.array(p.parent) >= 0) for p, s in zip(pages, start)])
        self.kind = np.concatenate([np.array(p.kind, np.int64) for p in pages])
        features = [f for p in pages for f in p.features]
        self.owner = np.repeat(np.arange(len(features)), [len(f) for f in features])
        self.feature = np.array([k for f in features for k in f], np.int64)
        self.texts = [t for p in pages for t in p.texts]
        self.labels = np.concatenate([np.array(p.labels, np.int64) for p in pages])
        depth = np.zeros(len(self.parent), np.int64)
        at, level = np.flatnonzero(self.parent < 0), 0
        children = np.argsort(self.parent, kind="stable")
        self.levels = [at]
        while len(at):
            lo, hi = (np.searchsorted(self.parent[children], at, side=s) for s in ("left", "right"))
            level += 1
            at = np.sort(np.concatenate([children[a:b] for a, b in zip(lo.tolist(), hi.tolist())])) if (hi > lo).any() else np.empty(0, np.int64)
            depth[at] = level
            if len(at):
                self.levels.append(at)

    def marginals(self, unary: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of content of every node, and joint label probabilities of every node's edge to its parent."""
        score = np.bincount(self.owner, weights=unary[self.feature], minlength=len(self.parent))
        up = np.stack([np.zeros_like(score), score], 1)
        message = np.zeros_like(up)
        for at in reversed(self.levels[1:]):
            message[at] = np.logaddexp.reduce(edge[self.kind[at]] + up[at][:, None, :], axis=2)
            for y in (0, 1):
                up[:, y] += np.bincount(self.parent[at], weights=message[at, y], minlength=len(up))
        belief = up.copy()
        joint = np.zeros((len(up), 2, 2))
        for at in self.levels[1:]:
            outside = belief[self.parent[at]] - message[at]
            both = outside[:, :, None] + edge[self.kind[at]] + up[at][:, None, :]
            belief[at] = np.logaddexp.reduce(both, axis=1)
            both -= np.logaddexp.reduce(both.reshape(len(at), 4), axis=1)[:, None, None]
            joint[at] = np.exp(both)
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500))), joint


def train(pages: list[str], rounds: int = 300, rate: float = 0.5, decay: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Unary and edge weights by gradient ascent on the likelihood of the labels (adaptive step for each weight)."""
    forest = Forest([Page(p) for p in pages])
    unary, edge = np.zeros(len(_FEATURES)), np.zeros((len(_EDGES), 2, 2))
    count = np.maximum(np.bincount(forest.feature, minlength=len(unary)), 1)
    seen_unary = np.bincount(forest.feature, weights=forest.labels[forest.owner].astype(float), minlength=len(unary))
    child = np.concatenate(forest.levels[1:])
    seen_edge = np.zeros_like(edge)
    np.add.at(seen_edge, (forest.kind[child], forest.labels[forest.parent[child]], forest.labels[child]), 1)
    n, total = len(forest.parent), [np.full_like(unary, 1e-8), np.full_like(edge, 1e-8)]
    for _ in range(rounds):
        p, joint = forest.marginals(unary, edge)
        expected = np.zeros_like(edge)
        np.add.at(expected, forest.kind[child], joint[child])
        g = [(seen_unary - np.bincount(forest.feature, weights=p[forest.owner], minlength=len(unary))) / n - decay * unary / len(count),
             (seen_edge - expected) / n - decay * edge / edge.size]
        for k, weight in enumerate((unary, edge)):
            total[k] += g[k] ** 2
            weight += rate * g[k] / np.sqrt(total[k])
    return unary, edge


def extract(pages: list[str], unary: np.ndarray, edge: np.ndarray) -> list[str]:
    """Main text of each page."""
    if not pages:
        return []
    forest = Forest([Page(p) for p in pages])
    p, _ = forest.marginals(unary, edge)
    out: list[list[str]] = [[] for _ in pages]
    for k, text in enumerate(forest.texts):
        if text is not None and p[k] >= 0.5:
            out[forest.page[k]].append(text)
    return [" ".join(parts) for parts in out]


def extract_main_text(pages: DataFrame, training_pages: list[str] | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page.  The model is a few hundred weights, trained before the job starts."""
    unary, edge = train(training_pages or labelled_pages())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "html"):
            texts = extract([h or "" for h in batch.column("html").to_pylist()], unary, edge)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), "html")
    kind = dict(rows.dtypes)["page_id"]
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
