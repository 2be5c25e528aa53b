"""Toxicity by a classifier chain.

Categories are predicted one after another.  The linear model of a category
sees a document's word features and the probabilities of all categories before
it.  While training, those probabilities come from models that have not seen
the document: training rows are dealt into folds, and each fold is predicted by
models of the other folds, so that later models learn how far earlier ones can
be trusted.

Features are 64-bit hashes of words (longest runs of letters and digits, A-Z
folded) and of their first four, five and six bytes, each present or absent in
a document.  A category's model keeps at most ``features`` of them, those that
tell its training rows apart best.  A model is a sorted array of hashes with
weights; scoring a document is one search of its distinct hashes in it.

Categories come from a table of labels with one 0/1 column each, in the order
of the chain; documents without a label are scored but not learned from.
Training takes a bounded sample of labelled documents, ``rows_per_side`` with
and as many without the last category, in expectation.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haltwerk.llm import linear
from haltwerk.llm.words import mixed, slices, split, texts_of

ROWS_PER_SIDE = 3_000
FEATURES = 2_048
FOLDS = 5

_BREAKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_PREFIXES = (4, 5, 6)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature hashes of the texts one after another, sorted in each, and where each text's begin."""
    t = split(column, spaces=_BREAKS)
    keys, docs = [t.word_hash()], [t.doc]
    for n in _PREFIXES:
        long = np.flatnonzero(t.ends - t.starts > n)
        keys.append(mixed(t.span_hash(t.starts[long], t.starts[long] + n) + np.uint64(n)))
        docs.append(t.doc[long])
    key, doc = np.concatenate(keys), np.concatenate(docs)
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    return key[new], np.searchsorted(doc[new], np.arange(t.n + 1))


@dataclass(frozen=True)
class Linear:
    keys: np.ndarray  # sorted hashes
    weights: np.ndarray
    chain: np.ndarray  # weights of the log odds of earlier categories
    bias: float

    def score(self, key: np.ndarray, starts: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        """Probabilities of texts given their hashes and earlier probabilities (texts by categories)."""
        at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        hit = np.flatnonzero(self.keys[at] == key) if len(self.keys) else np.zeros(0, int)
        running = np.concatenate(([0.0], np.cumsum(self.weights[at[hit]]))) if len(self.keys) else np.zeros(1)
        where = np.searchsorted(hit, starts)
        own = running[where[1:]] - running[where[:-1]]
        return linear.sigmoid(own + _odds(earlier) @ self.chain + self.bias)


def _odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p)) / 4


def _selected(key: np.ndarray, row: np.ndarray, target: np.ndarray, features: int) -> np.ndarray:
    """The hashes whose presence tells the target apart best, by log-likelihood ratio; at least three rows each."""
    kinds, where = np.unique(key, return_inverse=True)
    n, m = len(target), target.sum()
    here = np.bincount(where, minlength=len(kinds)).astype(float)
    good = np.bincount(where, target[row], minlength=len(kinds))

    def h(k: np.ndarray, of: np.ndarray) -> np.ndarray:
        p = np.clip(k / np.maximum(of, 1), 1e-12, 1 - 1e-12)
        return k * np.log(p) + (of - k) * np.log(1 - p)

    gain = h(good, here) + h(m - good, n - here) - h(np.array(float(m)), np.array(float(n)))
    gain[here < 3] = 0
    best = np.lexsort((kinds, -gain))[:features]
    return np.sort(kinds[best[gain[best] > 4.0]])


def _fit_one(key: np.ndarray, starts: np.ndarray, rows: np.ndarray, target: np.ndarray, earlier: np.ndarray, features: int) -> Linear:
    """One linear model on the given rows."""
    n = np.diff(starts)[rows]
    row = np.repeat(np.arange(len(rows)), n)
    flat = np.concatenate([np.zeros(0, np.uint64), *(key[starts[r] : starts[r + 1]] for r in rows)])
    y = target[rows].astype(float)
    chosen = _selected(flat, row, y, features)
    if not len(chosen):
        share = float(np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3))
        return Linear(chosen, np.zeros(0), np.zeros(earlier.shape[1]), float(np.log(share / (1 - share))))
    at = np.minimum(np.searchsorted(chosen, flat), len(chosen) - 1)
    hit = chosen[at] == flat
    x = linear.Sparse(row[hit], at[hit], np.ones(int(hit.sum())), len(rows), len(chosen))
    w, u, b = linear.fit_logistic(x, _odds(earlier[rows]), y, l2=1e-4, steps=400)
    return Linear(chosen, w, u, b)


@dataclass(frozen=True)
class Chain:
    categories: tuple[str, ...]
    models: tuple[Linear, ...]

    def probabilities(self, key: np.ndarray, starts: np.ndarray) -> np.ndarray:
        p = np.zeros((len(starts) - 1, 0))
        for model in self.models:
            p = np.column_stack((p, model.score(key, starts, p)))
        return p


def fit_chain(key: np.ndarray, starts: np.ndarray, targets: np.ndarray, categories: Sequence[str], features: int = FEATURES, folds: int = FOLDS) -> Chain:
    """Train the chain on texts' hashes and 0/1 targets (texts by categories)."""
    n = len(starts) - 1
    fold = np.arange(n) % folds
    outside = np.zeros((n, 0))  # probabilities from models that haven't seen the row
    models = []
    for k in range(len(categories)):
        target = targets[:, k]
        models.append(_fit_one(key, starts, np.arange(n), target, outside, features))
        if k + 1 < len(categories):
            p = np.zeros(n)
            for f in range(folds):
                mine, others = np.flatnonzero(fold == f), np.flatnonzero(fold != f)
                part = _fit_one(key, starts, others, target, outside, features)
                p[mine] = part.score(key, starts, outside)[mine]
            outside = np.column_stack((outside, p))
    return Chain(tuple(categories), tuple(models))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    categories: Sequence[str],
    derived: Mapping[str, Column] | None = None,
    rows_per_side: int = ROWS_PER_SIDE,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> Chain:
    """Train on a bounded sample of the labelled documents.

    ``labels`` has the id and a 0/1 column per category, but for those in
    ``derived``: 0/1 expressions over ``text`` and the other categories, for
    finer categories than the labels have.  NULL labels and ids are left out; of
    several labels of one id one counts.
    """
    target, derived = categories[-1], dict(derived or {})
    given = [c for c in categories if c not in derived]
    known = labels.select(F.col(id_column).alias("label_id"), *given).dropna().groupBy("label_id").agg(*(F.max(c).alias(c) for c in given))
    sides = {int(r[0]): r[1] for r in known.groupBy(F.col(target).cast("int")).count().collect()}
    spot = F.pmod(F.xxhash64("label_id"), F.lit(1 << 20))
    share = F.lit(0)
    for side, n in sides.items():
        share = F.when(F.col(target) == side, F.lit(int(min(1.0, rows_per_side / n) * (1 << 20)))).otherwise(share)
    drawn = known.where(spot < share)
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    rows = rows.join(F.broadcast(drawn), F.col("doc_id") == F.col("label_id"))# at most 2 * rows_per_side labels
    rows = rows.select("doc_id", "text", *(derived.get(c, F.col(c)).cast("int").alias(c) for c in categories))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch)
            for a, b in slices(texts):
                key, starts = features(texts[a:b])
                lists = [key[i:j].tobytes() for i, j in zip(starts[:-1], starts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], pa.array(lists, pa.binary()), *(batch.column(2 + k)[a:b].cast(pa.int32()) for k in range(len(categories)))],
                    names=["doc_id", "keys", *categories],
                )

    kind = docs.schema[id_column].dataType.simpleString()
    sample = rows.mapInArrow(run, ", ".join([f"doc_id {kind}", "keys binary", *(f"`{c}` int" for c in categories)])).toArrow().to_pylist()
    sample.sort(key=lambda r: (r["doc_id"], r["keys"]))
    keys = [np.frombuffer(r["keys"], np.uint64) for r in sample]
    starts = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int64)
    targets = np.array([[r[c] for c in categories] for r in sample], float).reshape(len(sample), len(categories))
    return fit_chain(np.concatenate([np.zeros(0, np.uint64), *keys]), starts, targets, categories)


def score(docs: DataFrame, chain: Chain, threshold: float = 0.35, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, a probability per category and ``flagged`` (the last one reaches the threshold) for every whole text.

    NULL text counts as empty: only the intercepts speak.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    names = [f"p_{c}" for c in chain.categories]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch)
            for a, b in slices(texts):
                p = chain.probabilities(*features(texts[a:b]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], *(pa.array(p[:, k]) for k in range(len(names))), pa.array(p[:, -1] >= threshold)], names=["doc_id", *names, "flagged"]
                )

    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(run, ", ".join([f"doc_id {kind}", *(f"`{n}` double" for n in names), "flagged boolean"]))
