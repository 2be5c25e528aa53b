"""Quality classifier: overlapping heuristic labellers, a label model, and a hashed linear scorer.

1. Labellers look at each text and vote good, bad or abstain.  They overlap:
   several see the same defect from different sides.
2. Expectation-maximisation (``weak_labels``) estimates their accuracies from
   the votes over all texts and gives each vote pattern a posterior.
3. Posteriors of a bounded sample of texts (``fit_rows``) are the soft targets
   of a logistic model on hashed features: word shapes, their bigrams and
   words, each as a share of the text's words.
4. The model scores every text; ``kept`` is score >= ``threshold``.

The scorer generalises where labellers abstain, such as on texts too short for
most of them.  NULL texts count as empty; an empty text has only the intercept
and the labellers' share for no words, and is not kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haltwerk.llm import linear, quality_rules, weak_labels
from haltwerk.llm.words import Texts, mixed, ngrams, slices, split, texts_of

DIMENSIONS = 1 << 14
FIT_ROWS = 8_000  # expected size of the sample the linear model is fitted on

LABELLERS = (
    "symbol_words", "marks", "upper_words", "shouts", "bars", "same_neighbour",
    "few_kinds", "repeats", "repeated_lines", "common_words", "sentence_length",
)

_LETTER = np.array([(65 <= b < 91) or (97 <= b < 123) or b >= 128 for b in range(256)])
_MARK = np.array([33 <= b < 127 and not chr(b).isalnum() for b in range(256)])


def _shapes(t: Texts) -> np.ndarray:
    """A small code per word: case of its first letters, last byte if a mark, length class, digits."""
    if not len(t.starts):
        return np.zeros(0, np.uint64)
    length = t.ends - t.starts
    first = t.data[t.starts]
    second = t.data[np.minimum(t.starts + 1, t.ends - 1)]
    last = t.data[t.ends - 1]
    case = ((first >= 65) & (first < 91)) * 1 + ((second >= 65) & (second < 91)) * 2
    mark = np.where(_MARK[last], last, 0)
    before = t.data[np.maximum(t.ends - 2, t.starts)]
    doubled = (_MARK[last] & (before == last)) * 1
    size = np.minimum(np.log2(length + 0.5).astype(np.int64), 6)
    letters = _LETTER[first] * 1
    return ((((case * 256 + mark) * 2 + doubled) * 8 + size) * 2 + letters).astype(np.uint64)


def _labels(t: Texts, m: dict[str, np.ndarray]) -> np.ndarray:
    """Votes of the labellers, texts by labellers."""
    n, words = t.n, np.maximum(m["n_words"], 1).astype(float)

    def share(flags: np.ndarray) -> np.ndarray:
        return np.bincount(t.doc, flags, minlength=n) / words

    some = m["n_words"] > 0
    enough = m["n_words"] >= 20

    def side(bad: np.ndarray, good: np.ndarray, when: np.ndarray) -> np.ndarray:
        return np.where(when & bad, -1, np.where(when & good, 1, 0)).astype(np.int8)

    hashes = t.word_hash()
    last = t.data[t.ends - 1] if len(t.ends) else np.zeros(0, np.uint8)
    symbol = np.isin(last, np.frombuffer(b"#*$%&|<>", np.uint8))
    first = t.data[t.starts] if len(t.starts) else np.zeros(0, np.uint8)
    second = t.data[np.minimum(t.starts + 1, t.ends - 1)] if len(t.starts) else first
    capital = (first >= 65) & (first < 91) & (second >= 65) & (second < 91)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (t.doc[1:] == t.doc[:-1])
    _, once = np.unique(mixed(hashes + mixed(t.doc.astype(np.uint64))), return_index=True)
    kinds = np.bincount(t.doc[once], minlength=n) / np.minimum(words, 200)
    short = share(t.ends - t.starts <= 4)
    closed = share(np.isin(last, np.frombuffer(b".!?", np.uint8)))
    marks = t.per_text(_MARK[t.data]) / words
    repeats = m["n_repeat_words"] / words
    symbols, shouts = share(symbol), m["n_shouts"] / words
    return np.stack(
        [
            side(symbols > 0.25, symbols < 0.08, some),
            side(marks > 0.9, marks < 0.45, some),
            side(share(capital) > 0.4, share(capital) < 0.1, some),
            side(shouts > 0.3, shouts < 0.1, some),
            side(m["n_bars"] / words > 0.15, m["n_bars"] / words < 0.02, some),
            side(share(same) > 0.3, share(same) < 0.1, enough),
            side(kinds < 0.15, kinds > 0.35, enough),
            side(repeats > 0.5, repeats < 0.2, enough),
            side(m["n_dup_lines"] > 0.3 * m["n_lines"], m["n_dup_lines"] < 0.1 * m["n_lines"], some),
            side(short < 0.05, short > 0.15, enough),
            side((closed > 0.9) | (closed < 0.004), (closed > 0.02) & (closed < 0.5), enough),
        ],
        axis=1,
    )


def _features(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, hashed column, share: shapes, pairs of shapes and words, summed per text and column."""
    shape = mixed(_shapes(t) + np.uint64(1 << 40))
    pair, at = ngrams(shape, t.doc, 2)
    keys = np.concatenate((shape, pair, t.word_hash()))
    doc = np.concatenate((t.doc, t.doc[at], t.doc))
    column = (keys % np.uint64(DIMENSIONS)).astype(np.int64)
    cell, count = np.unique(doc * DIMENSIONS + column, return_counts=True)
    words = np.maximum(t.words_per_text(), 1)
    return cell // DIMENSIONS, cell % DIMENSIONS, count / words[cell // DIMENSIONS]


@dataclass(frozen=True)
class QualityModel:
    labels: weak_labels.LabelModel
    weights: np.ndarray
    intercept: float


def _source(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))


def voted(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_words and vote pattern of every text."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch)
            for a, b in slices(texts):
                t = split(texts[a:b], lower=False)
                m = quality_rules.measures(t)
                votes = pa.array(quality_rules.pattern(_labels(t, m)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(m["n_words"].astype(np.int64)), votes], names=["doc_id", "n_words", "pattern"])

    return _source(docs, id_column, text_column).mapInArrow(run, f"doc_id {kind}, n_words bigint, pattern bigint")


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS, id_column: str = "doc_id", text_column: str = "text", l2: float = 1e-4) -> QualityModel:
    """Label model over all texts; linear model on about ``fit_rows`` texts drawn by a hash of id and text.

    The sample goes to the driver as hashed features: at most ``fit_rows`` rows
    in expectation, a few kilobytes each.
    """
    votes = voted(docs, id_column, text_column).groupBy("pattern").count()
    rows = sorted(map(tuple, votes.collect()))  # at most 3^labellers rows
    patterns = np.array([r[0] for r in rows], np.int64)
    counts = np.array([r[1] for r in rows], float)
    labels = weak_labels.fit(quality_rules.votes_of(patterns, len(LABELLERS)), counts)
    share = min(1.0, fit_rows / max(counts.sum(), 1))
    drawn = _source(docs, id_column, text_column).where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < int(share * (1 << 20)) + (share == 1.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch)
            for a, b in slices(texts):
                t = split(texts[a:b], lower=False)
                votes = quality_rules.pattern(_labels(t, quality_rules.measures(t)))
                row, column, value = _features(t)
                ends = np.searchsorted(row, np.arange(t.n + 1))
                packed = [
                    (column[i:j].astype(np.uint16).tobytes(), value[i:j].astype(np.float32).tobytes())
                    for i, j in zip(ends[:-1], ends[1:], strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(votes), pa.array([p[0] for p in packed], pa.binary()), pa.array([p[1] for p in packed], pa.binary())],
                    names=["pattern", "columns", "shares"],
                )

    sample = drawn.mapInArrow(run, "pattern bigint, columns binary, shares binary").toArrow().to_pylist()
    sample.sort(key=lambda r: (r["pattern"], r["columns"], r["shares"]))
    column = [np.frombuffer(r["columns"], np.uint16) for r in sample]
    value = [np.frombuffer(r["shares"], np.float32) for r in sample]
    target = labels.posterior(quality_rules.votes_of(np.array([r["pattern"] for r in sample], np.int64), len(LABELLERS)))
    x = linear.Sparse(
        np.repeat(np.arange(len(sample)), [len(c) for c in column]),
        np.concatenate([np.zeros(0, np.int64), *column]).astype(np.int64),
        np.concatenate([np.zeros(0), *value]).astype(float),
        len(sample),
        DIMENSIONS,
    )
    bad = max((1 - target).sum(), 1.0)
    weight = target + (1 - target) * min(max(target.sum() / bad, 1.0), 4.0)  # bad texts are few
    w, _, b = linear.fit_logistic(x, np.zeros((len(sample), 0)), target, weight, l2)
    return QualityModel(labels, w, b)


def score(docs: DataFrame, model: QualityModel, threshold: float = 0.5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_words, ``label`` (posterior of the votes), ``score`` and ``kept`` of every text."""
    kind = docs.schema[id_column].dataType.simpleString()
    labels, weights, intercept = model.labels, model.weights, model.intercept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch)
            for a, b in slices(texts):
                t = split(texts[a:b], lower=False)
                good = labels.posterior(_labels(t, quality_rules.measures(t)))
                row, column, value = _features(t)
                s = linear.sigmoid(np.bincount(row, value * weights[column], minlength=t.n) + intercept)
                words = t.words_per_text().astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], pa.array(words), pa.array(good), pa.array(s), pa.array((s >= threshold) & (words > 0))],
                    names=["doc_id", "n_words", "label", "score", "kept"],
                )

    return _source(docs, id_column, text_column).mapInArrow(run, f"doc_id {kind}, n_words bigint, label double, score double, kept boolean")


def classify(docs: DataFrame, threshold: float = 0.5, fit_rows: int = FIT_ROWS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Fit on the texts and score them all."""
    return score(docs, fit(docs, fit_rows, id_column, text_column), threshold, id_column, text_column)




def good(docs: DataFrame, threshold: float = 0.5, fit_rows: int = FIT_ROWS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows that ``classify`` keeps, with all their columns, decided row by row without a join."""
    model = fit(docs, fit_rows, id_column, text_column)
    at = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).fill_null("")
            keep = np.zeros(batch.num_rows, bool)
            for a, b in slices(texts):
                t = split(texts[a:b], lower=False)
                row, column, value = _features(t)
                s = linear.sigmoid(np.bincount(row, value * model.weights[column], minlength=t.n) + model.intercept)
                keep[a:b] = (s >= threshold) & (t.words_per_text() > 0)
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
