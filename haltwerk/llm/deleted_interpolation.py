"""Language-model scores by deleted interpolation.

The probability of word w after v mixes maximum-likelihood estimates:

    P(w | v) = l2(b) c(v w) / c(v) + l1(b) c(w) / N + l0(b) / (V + 1)

with a set of weights for each bucket b of context frequency, b = 1 +
floor(log2 c(v)), and 0 for contexts never seen.  A text is a start sign, its
words, and one end.  The weights come from expectation-maximisation on counts
that were held out: a fold of the training texts is deleted from the counts,
the remaining counts predict it, and each bucket takes the weights under which
its held-out tokens are likeliest.  The final model counts all training texts.

How counts reach the texts: texts are dealt into groups of a few megabytes by a
hash of the row's number, equal rows too (so the table must give the same rows in
the same partitions each time it is read, as a scan of files does).  A group sends each distinct word and word pair once, with its count, as
sorted packed arrays, one row per range of hashes; a range adds up what it got
and sends the totals back to the groups that asked.  What is shuffled is the
distinct n-grams of each group, no word is hotter than another, and no table of
counts is ever in one place.  Words are 64-bit hashes (see ``words``).

NULL text is the empty text: one token, its end.  A NULL id counts as the empty
string in the choice of training texts.  Repeated ids are scored one by one.
Without any training text every token has probability 1 / (V + 1) = 1.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haltwerk.llm import packed, scratch
from haltwerk.llm.words import mixed, slices, split, texts_of

GROUP_BYTES = 4 << 20
RANGE_BYTES = 8 << 20
FOLDS = 8
BUCKETS = 32
STEPS = 4  # levels per octave of a probability in the held-out counts

START = np.uint64(0x5BD1E995_00000001)
END = np.uint64(0x5BD1E995_00000002)
_LEFT, _RIGHT = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


@dataclass(frozen=True)
class Model:
    tokens: int  # N
    kinds: int  # V
    weights: np.ndarray  # BUCKETS by 3: pair, word, uniform


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def _sequences(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of start, words and end of all texts in a row, and the number of words of each text."""
    parts, lengths = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for a, b in slices(column):
        t = split(column[a:b])
        n = t.words_per_text()
        first = np.cumsum(n + 2) - (n + 2)
        seq = np.empty(int((n + 2).sum()), np.uint64)
        seq[first], seq[first + n + 1] = START, END
        seq[np.arange(len(t.starts)) + 2 * t.doc + 1] = t.word_hash()
        parts.append(seq)
        lengths.append(n)
    return np.concatenate(parts), np.concatenate(lengths)


def _pairs(seq: np.ndarray) -> np.ndarray:
    """Hash of each neighbouring pair; those that begin with an end stand between texts."""
    return mixed(seq[:-1] * _LEFT + seq[1:] * _RIGHT)


def _grams(seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Single words (with start signs) and pairs of a sequence."""
    if not len(seq):
        return seq, seq
    return seq, _pairs(seq)[seq[:-1] != END]


_REQUEST = "size int, part int, pid bigint, n bigint, hashes binary, counts binary, aside binary"
_REPLY = "pid bigint, size int, part int, n bigint, counts binary"


def _requests(size: int, pid: int, hashes: np.ndarray, counts: np.ndarray, aside: np.ndarray, parts: int) -> Iterator[dict]:
    where = np.searchsorted(packed.part_of(hashes, parts), np.arange(parts + 1, dtype=np.uint64))
    for part in np.flatnonzero(np.diff(where)):
        i, j = where[part], where[part + 1]
        yield {
            "size": size, "part": int(part), "pid": pid, "n": int(j - i), "hashes": packed.ascending(hashes[i:j]),
            "counts": packed.planes(counts[i:j]), "aside": packed.planes(aside[i:j]),
        }


def _batch(rows: list[dict], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pylist(rows, schema)


_ARROW_REQUEST = pa.schema(
    [("size", pa.int32()), ("part", pa.int32()), ("pid", pa.int64()), ("n", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary()), ("aside", pa.binary())]
)
_ARROW_REPLY = pa.schema([("pid", pa.int64()), ("size", pa.int32()), ("part", pa.int32()), ("n", pa.int64()), ("counts", pa.binary())])


def _asked(role: np.ndarray, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence of texts, lengths, and each element's role (1 counted, 2 set aside, 0 only asked for)."""
    seq, lengths = _sequences(column)
    return seq, lengths, np.repeat(role, lengths + 2)


def _group_requests(parts: int):  # noqa: ANN202
    def run(table: pa.Table) -> pa.Table:
        pid = table.column("pid")[0].as_py()
        seq, _, role = _asked(table.column("role").to_numpy(), texts_of(table.combine_chunks().to_batches()[0]))
        inner = seq[:-1] != END
        rows: list[dict] = []
        for size, grams, roles in ((1, seq, role), (2, _grams(seq)[1], role[1:][inner])):
            hashes, where = np.unique(grams, return_inverse=True)
            counts = np.bincount(where, roles == 1, minlength=len(hashes)).astype(np.uint64)
            aside = np.bincount(where, roles == 2, minlength=len(hashes)).astype(np.uint64)
            rows += _requests(size, pid, hashes, counts, aside, parts)
        return _batch(rows, _ARROW_REQUEST)

    return run


def _summed(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    h, where = np.unique(np.concatenate(hashes), return_inverse=True)
    return h, np.bincount(where, np.concatenate(counts), minlength=len(h)).astype(np.uint64)


def _count_only(parts: int, limit: int = 1 << 21):  # noqa: ANN202
    """Distinct n-grams of a partition's texts with counts; flushed beyond ``limit`` distinct ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {1: ([], []), 2: ([], [])}

        def flush() -> Iterator[pa.RecordBatch]:
            for size, (hashes, counts) in held.items():
                if hashes:
                    h, c = _summed(hashes, counts)
                    yield from _batch(list(_requests(size, -1, h, c, np.zeros(len(h), np.uint64), parts)), _ARROW_REQUEST).to_batches()
                hashes.clear()
                counts.clear()

        for batch in batches:
            texts = texts_of(batch)
            for a, b in slices(texts, 4 << 20):
                seq, _ = _sequences(texts[a:b])
                for size, grams in enumerate(_grams(seq), 1):
                    h, c = np.unique(grams, return_counts=True)
                    held[size][0].append(h)
                    held[size][1].append(c)
                if sum(map(len, held[2][0])) > limit:
                    h, c = _summed(*held[2])
                    held[2] = ([h], [c])
                    if len(h) > limit // 2:
                        yield from flush()
        yield from flush()

    return run


def _replies(table: pa.Table) -> pa.Table:
    """Totals of one range of hashes, to every group that asked; pid -2 carries the sums of the range."""
    rows = table.to_pylist()
    size, part = rows[0]["size"], rows[0]["part"]
    hashes = np.concatenate([packed.from_ascending(r["hashes"], r["n"]) for r in rows])
    kinds, where = np.unique(hashes, return_inverse=True)
    counts = np.bincount(where, np.concatenate([packed.numbers(r["counts"], r["n"]) for r in rows]), minlength=len(kinds)).astype(np.uint64)
    out, at = [], 0
    for r in rows:
        if r["pid"] >= 0:
            out.append({"pid": r["pid"], "size": size, "part": part, "n": r["n"], "counts": packed.planes(counts[where[at : at + r["n"]]])})
        at += r["n"]
    if size == 1:
        aside = np.bincount(where, np.concatenate([packed.numbers(r["aside"], r["n"]) for r in rows]), minlength=len(kinds)).astype(np.uint64)
        word = kinds != START
        sums = [counts[word].sum(), (counts[word] > 0).sum(), (counts + aside)[word].sum(), ((counts + aside)[word] > 0).sum()]
        out.append({"pid": -2, "size": size, "part": part, "n": 4, "counts": packed.planes(np.array(sums, np.uint64))})
    return _batch(out, _ARROW_REPLY)


def _range_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's share of the sums that ranges report, as plain columns for Spark to add up."""
    total = np.zeros(4, np.uint64)
    for batch in batches:
        for counts in batch.column(0).to_pylist():
            total += packed.numbers(counts, 4)
    yield pa.RecordBatch.from_arrays([pa.array([int(x)], pa.int64()) for x in total], names=["kept", "kept_kinds", "tokens", "kinds"])


def _known(seq: np.ndarray, replies: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """c(v), c(w) and c(v w) of every token of a group's sequence, in order (starts and texts' edges left out)."""
    rows = sorted(replies.to_pylist(), key=lambda r: (r["size"], r["part"]))
    found = []
    inner = seq[:-1] != END
    for size, grams in ((1, seq), (2, _grams(seq)[1])):
        kinds, where = np.unique(grams, return_inverse=True)
        totals = np.concatenate([np.zeros(0, np.uint64), *(packed.numbers(r["counts"], r["n"]) for r in rows if r["size"] == size)])
        if len(totals) != len(kinds):
            raise ValueError("a group's n-grams changed between two reads of the table")
        found.append(totals[where].astype(np.int64))
    single, pair = found
    return single[:-1][inner], single[1:][inner], pair


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.where(context > 0, np.log2(np.maximum(context, 1)).astype(np.int64) + 1, 0), BUCKETS - 1)


def _level(p: np.ndarray) -> np.ndarray:
    """Quantised minus log2 of a probability; -1 for zero."""
    return np.where(p > 0, np.rint(-STEPS * np.log2(np.maximum(p, 1e-300))).astype(np.int64), -1)


def _held_counts(kept_tokens: int):  # noqa: ANN202
    schema = pa.schema([(c, pa.int64()) for c in ("bucket", "pair", "word", "n")])

    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        seq, _ = _sequences(texts_of(docs.combine_chunks().to_batches()[0]))
        context, word, pair = _known(seq, replies)
        cell = np.stack((_bucket(context), _level(pair / np.maximum(context, 1)), _level(word / max(kept_tokens, 1))))
        cells, n = np.unique(cell, axis=1, return_counts=True)
        return pa.Table.from_arrays([*(pa.array(c) for c in cells), pa.array(n)], schema=schema)

    return run


def mixture(cells: np.ndarray, kinds: int, rounds: int = 100) -> np.ndarray:
    """Weights per bucket by expectation-maximisation on held-out counts.

    ``cells``: rows of bucket, pair level, word level, count.  Buckets without
    held-out tokens take the weights of the nearest lower bucket that has some.
    """
    cells = cells[np.lexsort(cells.T[::-1])] if len(cells) else cells.reshape(0, 4)
    weights = np.full((BUCKETS, 3), 1 / 3)
    last = np.array([0.0, 0.9, 0.1])
    for b in range(BUCKETS):
        rows = cells[cells[:, 0] == b]
        n = rows[:, 3].astype(float)
        if n.sum() > 0:
            p = np.stack([np.where(rows[:, k] >= 0, 2.0 ** (-rows[:, k] / STEPS), 0.0) for k in (1, 2)] + [np.full(len(rows), 1 / (kinds + 1))], axis=1)
            w = np.full(3, 1 / 3)
            for _ in range(rounds):
                share = p * w
                share /= share.sum(1, keepdims=True)
                w = (n @ share + 1e-3) / (n.sum() + 3e-3)
            last = w
        weights[b] = last
    weights[0, 0] = 0.0  # no pair was seen after an unseen context
    weights[0] /= weights[0].sum()
    return weights


def _prepared(docs: DataFrame, id_column: str, text_column: str, groups: int) -> DataFrame:
    held = is_held_out(F.col(id_column))
    fold = F.pmod(F.xxhash64(id_column), F.lit(FOLDS)) == 0
    return docs.select(
        F.col(id_column).alias("doc_id"),
        F.col(text_column).alias("text"),
        held.alias("held_out"),
        (~held & fold).alias("aside"),
        # by the row's number, so that equal rows don't fill one group
        F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).alias("pid"),
    )


def fit(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", total: int | None = None) -> Model:
    """Counts of N and V, and mixture weights from the deleted fold."""
    total = scratch.text_bytes(docs, text_column) if total is None else total
    groups, parts = max(1, math.ceil(total / FOLDS / GROUP_BYTES)), max(1, math.ceil(total / RANGE_BYTES))
    rows = _prepared(docs, id_column, text_column, groups)
    counted = rows.where(~F.col("held_out") & ~F.col("aside")).select("text").mapInArrow(_count_only(parts), _REQUEST)
    fold = rows.where("aside").select("text", "pid", F.lit(2).alias("role")).repartition(max(1, groups // 2), "pid")
    asked = fold.groupBy("pid").applyInArrow(_group_requests(parts), _REQUEST)
    replies = scratch.written(counted.unionByName(asked).groupBy("size", "part").applyInArrow(_replies, _REPLY), "interpolation-replies")
    sums = replies.where("pid = -2").select("counts").mapInArrow(_range_sums, "kept bigint, kept_kinds bigint, tokens bigint, kinds bigint")
    kept, tokens, kinds = (int(x or 0) for x in sums.agg(F.sum("kept"), F.sum("tokens"), F.sum("kinds")).first())
    cells = (
        fold.groupBy("pid")
        .cogroup(replies.where("pid >= 0").groupBy("pid"))
        .applyInArrow(_held_counts(kept), "bucket bigint, pair bigint, word bigint, n bigint")
        .groupBy("bucket", "pair", "word")
        .agg(F.sum("n").alias("n"))
        .collect()
    )  # levels of two probabilities per bucket: bounded whatever the corpus holds
    return Model(tokens, kinds, mixture(np.array([tuple(r) for r in cells], np.int64).reshape(-1, 4), kinds))


def _scores(model: Model, kind: pa.DataType):  # noqa: ANN202
    schema = pa.schema(
        [("doc_id", kind), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]
    )

    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        docs = docs.combine_chunks()
        seq, lengths = _sequences(texts_of(docs.to_batches()[0])) if docs.num_rows else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        context, word, pair = _known(seq, replies)
        w = model.weights[_bucket(context)]
        n, v = model.tokens, model.kinds
        p = w[:, 0] * pair / np.maximum(context, 1) + w[:, 1] * word / max(n, 1) + w[:, 2] / (v + 1)
        base = np.log10((word + 1) / (n + (v + 1)))
        doc = np.repeat(np.arange(len(lengths)), lengths + 1)

        def total(x: np.ndarray) -> np.ndarray:
            return np.bincount(doc, x, minlength=len(lengths))

        columns = [
            docs.column("doc_id"), docs.column("held_out"), pa.array(lengths + 1), pa.array(total(word > 0).astype(np.int64)),
            pa.array(np.full(len(lengths), n)), pa.array(total(base)), pa.array(total(np.log10(p))),
        ]
        return pa.Table.from_arrays(columns, schema=schema)

    return run


def score(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """log10 probability of every whole text under the model, with the add-one unigram score beside it.

    Returns doc_id, held_out, n_tokens (with the end), n_known (tokens seen in
    training), train_tokens, base_score, score.
    """
    total = scratch.text_bytes(docs, text_column)
    model = fit(docs, id_column, text_column, total)
    groups, parts = max(1, math.ceil(total / GROUP_BYTES)), max(1, math.ceil(total / RANGE_BYTES))
    role = F.when(F.col("held_out"), 0).otherwise(1).alias("role")
    dealt = _prepared(docs, id_column, text_column, groups).select("doc_id", "text", "held_out", "pid", role).repartition(max(1, groups // 2), "pid")
    replies = dealt.groupBy("pid").applyInArrow(_group_requests(parts), _REQUEST).groupBy("size", "part").applyInArrow(_replies, _REPLY)
    kind = docs.schema[id_column].dataType
    arrow = pa.schema(docs.select(id_column).limit(0).toArrow().schema).field(0).type
    return (
        dealt.groupBy("pid")
        .cogroup(replies.where("pid >= 0").groupBy("pid"))
        .applyInArrow(
            _scores(model, arrow),
            f"doc_id {kind.simpleString()}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
        )
    )
