"""Quality rules by weak supervision.

Every rule looks at measures of one text and votes that it is good, bad, or
abstains.  The label model in ``weak_labels`` learns the accuracies of the
rules from their votes over all texts, and the posterior probability of a good
text decides, in place of a demand that all rules pass.

NULL text counts as empty: no words, no votes but the one on length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haltwerk.llm import scratch, weak_labels
from haltwerk.llm.words import Texts, mixed, ngrams, slices, split, texts_of

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_closed_lines", "n_upper", "n_lower", "n_bars", "n_shouts", "n_marks",
)

RULES = ("length", "word_length", "symbols", "marks", "upper", "lines", "repeats", "bars", "closings")

MIN_WORDS = 50


def _table(chars: str) -> np.ndarray:
    flags = np.zeros(256, np.int64)
    flags[[ord(c) for c in chars]] = 1
    return flags


_SYMBOLS = _table("#*$%&|<>")
_UPPER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LOWER = _table("abcdefghijklmnopqrstuvwxyz")
_BARS = _table("|")
_SHOUTS = _table("!")
_CLOSING = _table(".!?:;")
_MARKS = _table("".join(c for c in map(chr, range(33, 127)) if not c.isalnum()))
_HEADS = np.array([0 if 0x80 <= b < 0xC0 else 1 for b in range(256)])  # bytes that begin a character
_INK = 1 - _table(" \t\n\r\x0b\x0c")


def _repeated(keys: np.ndarray) -> np.ndarray:
    """True where a value occurs twice or more."""
    _, where, count = np.unique(keys, return_inverse=True, return_counts=True)
    return count[where] > 1


def _lines(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines with a word, repeated lines, and lines that end in a closing mark, per text."""
    breaks = np.flatnonzero(t.data == 10)
    starts = np.unique(np.concatenate((t.offsets[:-1], breaks + 1)))
    starts = starts[starts < len(t.data)]
    if not len(starts):
        return (np.zeros(t.n, np.int64),) * 3
    doc = np.searchsorted(t.offsets, starts, "right") - 1
    ends = np.minimum(np.append(starts[1:], len(t.data)), t.offsets[doc + 1])
    ends = ends - (t.data[ends - 1] == 10)
    first = np.searchsorted(t.starts, starts)
    full = first < np.searchsorted(t.starts, ends)
    starts, ends, doc = starts[full], ends[full], doc[full]
    last = t.ends[np.searchsorted(t.ends, ends, "right") - 1]
    closed = _CLOSING[t.data[last - 1]]
    key = mixed(t.span_hash(starts, ends) + mixed(doc.astype(np.uint64)))
    _, once = np.unique(key, return_index=True)
    count = np.bincount(doc, minlength=t.n)
    return count, count - np.bincount(doc[once], minlength=t.n), np.bincount(doc, closed, minlength=t.n).astype(np.int64)


def measures(t: Texts) -> dict[str, np.ndarray]:
    """All measures of the texts of one slice; ``t`` must not fold case."""
    hashes = t.word_hash()
    gram, at = ngrams(hashes, t.doc, 3)
    twice = at[_repeated(mixed(gram + mixed(t.doc[at].astype(np.uint64))))]
    covered = np.zeros(len(hashes), bool)
    for i in range(3):
        covered[twice + i] = True
    lines, dup, closed = _lines(t)
    return {
        "n_words": t.words_per_text(),
        "word_chars": t.per_text(_HEADS[t.data] * _INK[t.data]),
        "n_symbols": t.per_text(_SYMBOLS[t.data]),
        "n_dup_lines": dup,
        "n_repeat_words": np.bincount(t.doc[covered], minlength=t.n),
        "n_lines": lines,
        "n_closed_lines": closed,
        "n_upper": t.per_text(_UPPER[t.data]),
        "n_lower": t.per_text(_LOWER[t.data]),
        "n_bars": t.per_text(_BARS[t.data]),
        "n_shouts": t.per_text(_SHOUTS[t.data]),
        "n_marks": t.per_text(_MARKS[t.data]),
    }


def vote(m: dict[str, np.ndarray]) -> np.ndarray:
    """Votes of the rules, texts by rules.  A text without words only fails on length."""
    words = np.maximum(m["n_words"], 1).astype(float)
    some = m["n_words"] > 0

    def between(bad: np.ndarray, good: np.ndarray) -> np.ndarray:
        return np.where(some & bad, -1, np.where(some & good, 1, 0)).astype(np.int8)

    mean = m["word_chars"] / words
    symbols = m["n_symbols"] / words
    upper = m["n_upper"] / np.maximum(m["n_upper"] + m["n_lower"], 1)
    lines = m["n_dup_lines"] / np.maximum(m["n_lines"], 1)
    repeats = m["n_repeat_words"] / words
    bars = m["n_bars"] / words
    marks = m["n_marks"] / words
    closed = m["n_closed_lines"] / np.maximum(m["n_lines"], 1)
    length = np.where(m["n_words"] < MIN_WORDS, -1, np.where(m["n_words"] >= 2 * MIN_WORDS, 1, 0)).astype(np.int8)
    return np.stack(
        [
            length,
            between((mean < 2.5) | (mean > 14), (mean > 3) & (mean < 11)),
            between(symbols > 0.3, symbols < 0.1),
            between(marks > 0.9, marks < 0.5),
            between(upper > 0.5, upper < 0.2),
            between(lines > 0.5, lines < 0.1),
            between(repeats > 0.4, repeats < 0.2),
            between((bars > 0.15) | (m["n_shouts"] / words > 0.3), (bars < 0.01) & (m["n_shouts"] / words < 0.1)),
            between(closed < 0.1, closed > 0.5),
        ],
        axis=1,
    )


def pattern(votes: np.ndarray) -> np.ndarray:
    """One number for each row of votes."""
    return (votes.astype(np.int64) + 1) @ (3 ** np.arange(votes.shape[1]))


def votes_of(patterns: np.ndarray, rules: int) -> np.ndarray:
    return (np.asarray(patterns, np.int64)[:, None] // (3 ** np.arange(rules))) % 3 - 1


def measured(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Measures and vote pattern of every text, over whole texts.

    Takes any columns besides the two named; NULL ids and repeated ids are
    rows like others.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    schema = ", ".join([f"doc_id {kind}", *(f"{m} bigint" for m in MEASURES), "pattern bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch)
            for a, b in slices(texts):
                m = measures(split(texts[a:b], lower=False))
                columns = [batch.column(0)[a:b], *(pa.array(m[k].astype(np.int64)) for k in MEASURES), pa.array(pattern(vote(m)))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *MEASURES, "pattern"])

    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, schema)


def fitted(table: DataFrame, rules: int = len(RULES)) -> tuple[weak_labels.LabelModel, DataFrame]:
    """The label model of a measured table, and the posterior of each of its vote patterns (at most 3^rules rows)."""
    rows = sorted(map(tuple, table.groupBy("pattern").count().collect()))
    patterns = np.array([r[0] for r in rows], np.int64)
    votes = votes_of(patterns, rules)
    model = weak_labels.fit(votes, np.array([r[1] for r in rows], float))
    good = model.posterior(votes)
    known = [(int(p), float(q)) for p, q in zip(patterns, good, strict=True)]
    return model, table.sparkSession.createDataFrame(known, "pattern bigint, good_probability double")


def apply_rules(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = 0.5) -> DataFrame:
    """Measures, ``good_probability`` (posterior), ``base_failed`` and ``kept`` of every text.

    ``base_failed``: under 50 words, or more than half of the words in three-word
    windows that occur twice or more.  Such texts are never kept; the posterior
    decides on the others.
    """
    table = scratch.written(measured(docs, id_column, text_column), "quality-rules")
    _, known = fitted(table)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        table.join(F.broadcast(known), "pattern")  # at most 3^rules rows
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("good_probability") >= threshold))
        .drop("pattern")
    )


def good(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows that ``apply_rules`` keeps, with all their columns, decided row by row without a join.

    The label model is fitted on the votes of all rows first; a second pass
    votes again and filters.
    """
    votes = measured(docs, id_column, text_column).groupBy("pattern").count()
    rows = sorted(map(tuple, votes.collect()))  # at most 3^rules rows
    model = weak_labels.fit(votes_of(np.array([r[0] for r in rows], np.int64), len(RULES)), np.array([r[1] for r in rows], float))
    at = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).fill_null("")
            keep = np.zeros(batch.num_rows, bool)
            for a, b in slices(texts):
                m = measures(split(texts[a:b], lower=False))
                failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
                keep[a:b] = ~failed & (model.posterior(vote(m)) >= threshold)
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
