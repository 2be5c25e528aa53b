"""Main text of web pages by a tree-structured graphical model.

Every block element and every run of text of a page is a variable: content or
not.  Unary potentials are a logistic model on a node's tag, class and role
words, share of linked text, length and punctuation.  Potentials between parent
and child say how often a label is passed down, for elements and for runs.
Sum-product messages go up the tree and down again and give each node's exact
marginal; runs of text with a marginal above one half are the main text.

The model is trained on labelled pages: a bounded sample (``fit_pages``) of the
given pages whose landmark elements tell the article from the rest.  Each is
used as it is, and twice more in another dress: landmarks become plain divisions
with class names in common use, and notices, sidebars, forms, related links and
reader comments are put around and into the article, with words of the page
itself.  So the model learns class words, links and shapes besides landmarks.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haltwerk.llm import linear
from haltwerk.llm.html_tree import Tree, parse
from haltwerk.llm.words import mixed

FIT_PAGES = 300
FIT_CHARS = 100_000  # longer pages teach no more, and cost more

# fixed values: words in class, id and role attributes, by what they announce
GROUPS = {
    "content": "article post entry story content body main text prose page-content maincontent single hentry",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs topbar toc pagination pager tabs skip",
    "header": "header masthead branding logo site-header top hero-header",
    "footer": "footer copyright colophon legal imprint site-footer bottom contentinfo",
    "side": "sidebar aside rail widget related recommended trending popular tags categories archive complementary",
    "notice": "cookie cookies consent gdpr notice banner popup modal overlay alert toast announcement paywall",
    "advert": "ad ads advert adverts advertisement sponsor sponsored promo promotion dfp adsense",
    "form": "form newsletter subscribe signup login search searchbox contact register",
    "comments": "comment comments reply replies respond discussion disqus thread responses reader-comments",
    "share": "share sharing social follow",
    "hidden": "hidden",
}
_GROUP_OF = {word: group for group, words in GROUPS.items() for word in words.split()}
_NAMES = re.compile(r"[a-z]+")
_LANDMARKS = {
    "article": "content", "main": "content", "nav": "menu", "header": "header", "footer": "footer", "aside": "side",
    "form": "form", "button": "form", "dialog": "notice", "fieldset": "form", "figure": "content", "menu": "menu", "address": "footer",
}
_OUTSIDE = frozenset(_GROUP_OF.values()) - {"content"}


def _groups(tag: str, marks: str) -> set[str]:
    found = {_GROUP_OF[w] for w in _NAMES.findall(marks) if w in _GROUP_OF} if marks else set()
    return found


@dataclass
class Nodes:
    """Features of the nodes of one page: names per node."""

    names: list[list[str]]
    parent: list[int]
    run: list[bool]
    kind: list[int]  # of the edge to the parent: is the child a run, does its class announce something, does the parent's


_SIZES = [f"size{i}" for i in range(40)]


def features(tree: Tree) -> Nodes:
    n = len(tree.tag)
    size, linked, runs = [0] * n, [0] * n, [0] * n
    for i in range(n - 1, 0, -1):
        if not tree.tag[i]:
            size[i], linked[i], runs[i] = len(tree.text[i]), tree.linked[i], 1
        p = tree.parent[i]
        size[p] += size[i]
        linked[p] += linked[i]
        runs[p] += runs[i]
    names: list[list[str]] = []
    marked: list[int] = []
    for i in range(n):
        tag = tree.tag[i]
        share = int(4 * linked[i] / size[i] + 0.5) if size[i] else 5
        if tag:
            own = [f"g:{g}" for g in sorted(_groups(tag, tree.marks[i]))]
            if tag in _LANDMARKS:
                own.append(f"g:{_LANDMARKS[tag]}")
                own.append(f"t:{tag}")
            elif tag not in ("div", "section"):
                own.append(f"t:{tag}")
            marked.append(int(any(x[:2] == "g:" for x in own)))
            names.append([*own, f"links{share}", f"deep{_SIZES[min(size[i].bit_length(), 14)]}", f"runs{min(runs[i].bit_length(), 6)}", "element"])
        else:
            text = tree.text[i]
            p = tree.parent[i]
            marked.append(0)
            stops = text.count(". ") + text.count(", ") + (text[-1] in ".!?,;:")
            names.append(
                [
                    f"r:{tree.tag[p] if tree.tag[p] not in ('div', 'section') else 'box'}", f"rlinks{share}", f"r{_SIZES[min(len(text).bit_length(), 12)]}",
                    f"stops{min(stops.bit_length(), 4)}", "run", *(["rights"] if "©" in text[:80] or "copyright" in text[:80].lower() else []),
                ]
            )
    run = [not t for t in tree.tag]
    kind = [0] + [4 * run[i] + 2 * marked[i] + marked[tree.parent[i]] for i in range(1, n)]
    return Nodes(names, tree.parent, run, kind)


@dataclass(frozen=True)
class ContentModel:
    weights: dict[str, float]
    bias: float
    passed: np.ndarray  # log potential [kind of edge, parent's label, child's label]

    def unary(self, names: list[list[str]]) -> list[float]:
        get = self.weights.get
        return [self.bias + sum(get(x, 0.0) for x in own) for own in names]


def marginals(unary: list[float], parent: list[int], kind: list[int], passed: np.ndarray) -> list[float]:
    """Probability of content of every node, exactly, by messages up and down the tree.

    ``unary`` is the log odds of content of each node by itself.  Parents stand
    before children; node 0 is the root.
    """
    table = passed.tolist()
    n = len(unary)
    in0, in1 = [0.0] * n, list(unary)  # log of own potential and messages from children
    up0, up1 = [0.0] * n, [0.0] * n

    def add(a: float, b: float) -> float:
        return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))

    for i in range(n - 1, 0, -1):
        (a, b), (c, d) = table[kind[i]]
        up0[i], up1[i] = add(in0[i] + a, in1[i] + b), add(in0[i] + c, in1[i] + d)
        in0[parent[i]] += up0[i]
        in1[parent[i]] += up1[i]
    out = [0.0] * n
    all0, all1 = in0, in1
    for i in range(n):
        if i:
            (a, b), (c, d) = table[kind[i]]
            p = parent[i]
            r0, r1 = all0[p] - up0[i], all1[p] - up1[i]  # the parent without this child
            all0[i] += add(r0 + a, r1 + c)
            all1[i] += add(r0 + b, r1 + d)
            low = max(all0[i], all1[i])
            all0[i], all1[i] = all0[i] - low, all1[i] - low
        z = all0[i] - all1[i]
        out[i] = 1 / (1 + math.exp(z)) if z < 700 else 0.0
    return out


def content(page: str, model: ContentModel) -> str:
    """Main text of a page: its content runs, one a line."""
    tree = parse(page)
    nodes = features(tree)
    p = marginals(model.unary(nodes.names), nodes.parent, nodes.kind, model.passed)
    return "\n".join(t for t, q, r in zip(tree.text, p, nodes.run, strict=True) if r and q > 0.5)


def landmark_labels(tree: Tree) -> list[bool] | None:
    """Labels of a page with an article element: what is in it, but for parts that announce something else.

    None for pages without one.
    """
    if "article" not in tree.tag:
        return None
    label: list[bool] = []
    for i, tag in enumerate(tree.tag):
        inside = label[tree.parent[i]] if i else False
        groups = _groups(tag, tree.marks[i]) | ({_LANDMARKS[tag]} if tag in _LANDMARKS else set())
        if tag == "header" and inside:
            groups.discard("header")  # the headline's
        label.append((inside or tag == "article") and not groups & _OUTSIDE)
    return label


def redressed(tree: Tree, label: list[bool], seed: int) -> tuple[Tree, list[bool]]:
    """The page in other clothes: landmarks as divisions with class names, and more that isn't content."""
    block = (1 << 16) - 1
    numbers = (np.arange(k, k + block, dtype=np.uint64) for k in itertools.count(1, block))
    draw = (x for some in numbers for x in mixed(some * np.uint64(2 * seed + 1)).tolist())  # without an end

    def pick(group: str) -> str:
        words = GROUPS[group].split()
        return words[next(draw) % len(words)]

    def chance(percent: int) -> bool:
        return next(draw) % 100 < percent

    out, labels = Tree(), []
    words = " ".join(t for t in tree.text if t).split() or ["text"]

    def put(tag: str, parent: int, marks: str, good: bool, text: str = "", linked: int = 0) -> int:
        out.tag.append(tag)
        out.parent.append(parent)
        out.marks.append(marks)
        out.text.append(text)
        out.linked.append(linked)
        labels.append(good)
        return len(labels) - 1

    def some(low: int, high: int) -> str:
        n, at = low + next(draw) % (high - low), next(draw) % len(words)
        return " ".join(words[at : at + n]) or words[0]

    def extra(parent: int, group: str) -> None:
        tags = {"side": "aside", "form": "form", "menu": "nav", "header": "header", "footer": "footer"}
        plain = group not in tags or chance(50)
        box = put("div" if plain else tags[group], parent, pick(group) if plain or chance(50) else "", False)
        if group in ("header", "footer", "side", "notice") and chance(70 if group == "header" else 40):
            put("", put(("h1", "h2", "h3")[next(draw) % 3], box, "", False), "", False, some(1, 6))
        if group == "comments":
            if chance(60):
                put("", put("h3", box, "", False), "", False, some(1, 4))
            for _ in range(1 + next(draw) % 4):
                one = put(("div", "li", "article")[next(draw) % 3], box, "comment" if chance(70) else "", False)
                put("", put("p", one, "", False), "", False, some(3, 60 if chance(70) else 150))
        elif group in ("menu", "side", "share"):
            for _ in range(2 + next(draw) % 5):
                text = some(1, 5)
                put("", put("li", box, "", False), "", False, text, len(text) if chance(85) else 0)
        else:
            put("", put("p", box, "", False) if chance(60) else box, "", False, some(3, 30 if chance(70) else 120))

    place = {}
    mode = next(draw) % 3
    bare, thin = chance(15), next(draw) % 101 if chance(60) else 0  # no html and body; share of paragraphs left out
    brief = chance(35)  # content runs of a few words
    gone: set[int] = set()
    for i, tag in enumerate(tree.tag):
        parent = place.get(tree.parent[i], -1) if i else -1
        if i and (tree.parent[i] in gone or (tag == "p" and label[i] and len(label) - i > 1 and chance(thin))):
            gone.add(i)
            continue
        if bare and tag in ("html", "body", "head"):
            place[i] = 0
            continue
        if not tag:
            text = tree.text[i]
            if brief and label[i]:
                text = " ".join(text.split()[: 1 + next(draw) % 14])
            put("", parent, "", label[i], text, min(tree.linked[i], len(text)))
            continue
        marks = tree.marks[i]
        if tag in _LANDMARKS and mode:
            group = _LANDMARKS[tag]
            marks, tag = (pick(group) if mode == 1 or group != "content" or chance(50) else ""), "div"
        elif marks and chance(50):
            groups = sorted(_groups(tag, marks))
            marks = pick(groups[0]) if groups else marks
        if tree.tag[i] == "article":
            for group in ("header", "side", "notice", "advert", "form"):
                if chance(60 if group == "header" else 35):
                    extra(parent, group)
        if tree.tag[i] == "article":
            for _ in range(next(draw) % 3):  # wrappers
                parent = put("div", parent, "", False)
        if tag == "p" and label[i] and chance(8):
            parent = put("blockquote", parent, "", True)
        elif tag == "p" and label[i] and chance(6):
            tag, parent = "li", put(("ul", "ol")[next(draw) % 2], parent, "", True)
        elif tag == "p" and label[i] and chance(3):
            tag, parent = "td", put("tr", put("table", parent, "", True), "", True)
        elif tag == "p" and label[i] and chance(4):
            tag = ("h2", "h3", "div", "pre")[next(draw) % 4]
        place[i] = put(tag, parent, marks, label[i])
        if tag == "h1" and label[i] and chance(30):
            out.tag[place[i]], out.marks[place[i]] = "header", ""
            place[i] = put("h1", place[i], "", True)
        if tree.tag[i] == "article" and chance(30):
            place[i] = put("div", place[i], pick("content") if chance(50) else "", True)
        if tree.tag[i] == "article" and chance(30):
            extra(place[i], ("advert", "share", "form")[next(draw) % 3])
    body = next((place[i] for i, t in enumerate(tree.tag) if t == "body" and i in place), 0)
    article = next((place[i] for i, t in enumerate(tree.tag) if t == "article"), body)
    for group in ("comments", "side", "form", "notice", "menu"):
        if chance(45):
            extra(article if group == "comments" and chance(50) else body, group)
    # children must follow parents, which they do; page order of the extras doesn't matter to the model
    return out, labels


class _Forest:
    """Labelled pages side by side, to pass messages through all of them level by level."""

    def __init__(self, rows: list[tuple[Nodes, list[bool]]]) -> None:
        self.index: dict[str, int] = {}
        row, column, parent, kind, label, level = [], [], [], [], [], []
        for nodes, good in rows:
            base = len(label)
            for i, names in enumerate(nodes.names):
                row += [base + i] * len(names)
                column += [self.index.setdefault(name, len(self.index)) for name in names]
                level.append(level[base + nodes.parent[i]] + 1 if i else 0)
                parent.append(base + nodes.parent[i] if i else -1)
            kind += nodes.kind
            label += good
        self.parent, self.kind, self.label = np.array(parent), np.array(kind), np.array(label, int)
        self.x = linear.Sparse(np.array(row), np.array(column), np.ones(len(row)), len(label), len(self.index))
        level = np.array(level)
        self.levels = [np.flatnonzero(level == k) for k in range(level.max() + 1)]

    def expected(self, unary: np.ndarray, passed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of the nodes, and expected counts of label pairs by kind of edge."""
        n = len(self.label)
        below = np.stack((np.zeros(n), unary), axis=1)
        up = np.zeros((n, 2))
        for at in self.levels[:0:-1]:
            up[at] = np.logaddexp.reduce(passed[self.kind[at]] + below[at][:, None, :], axis=2)
            for a in (0, 1):
                below[:, a] += np.bincount(self.parent[at], up[at, a], minlength=n)
        full = below.copy()
        pairs = np.zeros_like(passed)
        for at in self.levels[1:]:
            rest = full[self.parent[at]] - up[at]
            joint = rest[:, :, None] + passed[self.kind[at]] + below[at][:, None, :]
            joint = np.exp(joint - joint.max((1, 2), keepdims=True))
            joint /= joint.sum((1, 2), keepdims=True)
            np.add.at(pairs, self.kind[at], joint)
            full[at] = np.log(joint.sum(1) + 1e-300)
        root = self.levels[0]
        full[root] -= np.logaddexp.reduce(full[root], axis=1, keepdims=True)
        return linear.sigmoid(full[:, 1] - full[:, 0]), pairs


def fit(pages: list[str], l2: float = 3e-6, steps: int = 300, rate: float = 0.1) -> ContentModel:
    """Train on labelled pages, those with an article element; deterministic.

    Unary and parent-child potentials are learned together, by gradient ascent
    on the likelihood of the labels given the pages: observed less expected
    counts, the latter from the same messages that label a page.  Without any
    labelled page the model knows only what class words and tags announce.
    """
    rows: list[tuple[Nodes, list[bool]]] = []
    for seed, page in enumerate(pages):
        tree = parse(page)
        label = landmark_labels(tree)
        if label is not None:
            rows.append((features(tree), label))
            for turn in (1, 2):
                other, labels = redressed(tree, label, 2 * seed + turn)
                rows.append((features(other), labels))
    if not rows:
        weights = {f"g:{g}": (3.0 if g == "content" else -6.0) for g in GROUPS} | {"t:nav": -6.0, "t:footer": -6.0, "t:p": 1.0, "run": 0.5}
        return ContentModel(weights, 0.0, np.log(np.array([[[0.7, 0.3], [0.05, 0.95]]] * 8)))
    forest = _Forest(rows)
    n = len(forest.label)
    seen = np.zeros((8, 2, 2))
    child = np.concatenate(forest.levels[1:])
    np.add.at(seen, (forest.kind[child], forest.label[forest.parent[child]], forest.label[child]), 1)
    w, b, passed = np.zeros(len(forest.index)), 0.0, np.zeros((8, 2, 2))
    first = [np.zeros_like(x) for x in (w, np.zeros(1), passed)]
    second = [np.zeros_like(x) for x in first]
    for t in range(1, steps + 1):
        p, pairs = forest.expected(forest.x.times(w) + b, passed)
        r = forest.label - p
        grads = [forest.x.transposed_times(r) / n - l2 * w, np.array([r.sum() / n]), (seen - pairs) / n - l2 * passed]
        moves = []
        for k, g in enumerate(grads):  # steps scaled by running moments
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            moves.append(rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-6))
        w, b, passed = w + moves[0], b + float(moves[1][0]), passed + moves[2]
    return ContentModel({name: float(w[k]) for name, k in forest.index.items()}, b, passed)


def fitted(
    pages: DataFrame, fit_pages: int = FIT_PAGES, id_column: str = "page_id", html_column: str = "html", fit_chars: int = FIT_CHARS
) -> ContentModel:
    """Train on about ``fit_pages`` of the pages that label themselves, drawn by a hash of the id and taken to the driver.

    Two bounds keep the sample small: pages of ``fit_chars`` characters or more
    train only if all labelled pages are that long, and then the eight shortest
    do; and no more than twice ``fit_pages`` rows are taken, should many rows be
    equal.
    """
    every = pages.where(F.col(html_column).rlike(r"(?i)<article[\s/>]"))
    labelled = every.where(F.length(html_column) < fit_chars)
    share = min(1.0, fit_pages / max(labelled.count(), 1))
    drawn = F.pmod(F.xxhash64(F.col(id_column), F.col(html_column)), F.lit(1 << 20)) < int(share * (1 << 20)) + (share == 1.0)
    sample = labelled.where(drawn).select(html_column).limit(2 * fit_pages).toArrow().column(0).to_pylist()
    if not sample:
        sample = every.orderBy(F.length(html_column), html_column).limit(8).select(html_column).toArrow().column(0).to_pylist()
    return fit(sorted(x for x in sample if x))


def extract(pages: DataFrame, model: ContentModel, id_column: str = "page_id", html_column: str = "html", carried: tuple[str, ...] = ("url",)) -> DataFrame:
    """page_id, carried columns, text and n_chars (code points) of every page, from its whole HTML.

    NULL HTML is an empty page with empty text.  Repeated rows and rows that
    share an id are read one by one; long pages are read whole.  ``carried`` must
    not name a column text or n_chars.
    """
    rows = pages.select(F.col(id_column).alias("page_id"), *carried, F.col(html_column).alias("html"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, body = list(range(batch.num_columns - 1)), batch.column(batch.num_columns - 1)
            for a in range(0, batch.num_rows, 256):
                texts = [content(x.as_py() or "", model) for x in body[a : a + 256]]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k)[a : a + 256] for k in keys), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=[*(batch.schema.names[k] for k in keys), "text", "n_chars"],
                )

    return rows.mapInArrow(run, f"{kinds}, text string, n_chars bigint")
