"""How filters act on each other, in every order they can be applied, from one table of counts.

Each document passes or fails every filter, whatever the order, so the numbers
of documents by pass and fail along five axes, a 2 x 2 x 2 x 2 x 2 tensor per
part of the corpus, hold all answers.  A question is a choice of pass, fail or
all on each axis, and its answer a contraction of the tensor with five vectors
of zeros and ones: all questions of all orders and steps are one ``einsum``.

The texts are read once, by column functions; what is shuffled is one small row
a document, and what leaves Spark's aggregates is 32 counts a part.  Whether a
text stood in a document with a smaller id before is decided by a join on both
the text's hash and the least id of that hash, so that no task holds all copies
of a text.

Filters (a document fails if): A, under 200 words; B, fewer distinct words than
half; C, A-Z are more than 2 % of the code points; D, any of ``#$%&*|``; E, its
text is that of a document with a smaller id, removed by another filter or not.
Words are longest runs of characters other than space and control white space;
case counts.

Results for odd rows: NULL text is the empty text (no words, so it fails A only,
and E if another empty text has a smaller id); a NULL source is the part "".  A
NULL id is neither smaller nor larger than any, so such rows never fail E and
have no labels.  Rows with equal id and text all count, and do not make each
other fail E.  Labels of an id given more than once count if any row has them.
An empty table has no parts and gives no rows.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haltwerk.llm import scratch

FILTERS = "ABCDE"
PARTS_AT_ONCE = 64  # 600 rows each

PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)


def text_failures(text: Column) -> dict[str, Column]:
    """The four conditions that a text decides by itself."""
    words = F.array_remove(F.split(text, r"[ \t-\r]+"), "")
    n = F.size(words)
    return {
        "A": n < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * n,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.char_length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def failures(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "source") -> DataFrame:
    """One row per distinct (id, part, text): doc_id, part, print of the text, n of rows, and A to D as bits 1 to 8."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    bits = sum(failed.cast("int") * (1 << k) for k, failed in enumerate(text_failures(text).values()))
    rows = docs.select(
        F.col(id_column).alias("doc_id"),
        F.coalesce(F.col(part_column).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("print"),
        bits.alias("bits"),
    )
    return rows.groupBy("doc_id", "part", "print", "bits").agg(F.count(F.lit(1)).alias("n"))


def cells(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "source") -> DataFrame:
    """Counts of documents by part and cell (bit k set: filter k fails): n, good, toxic."""
    rows = scratch.written(failures(docs, id_column, text_column, part_column), "filter-failures")
    firsts = rows.groupBy("print").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = labels.groupBy(F.col(id_column).alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    marked = rows.join(firsts, ["doc_id", "print"], "left").join(marks, "doc_id", "left")
    repeated = F.col("first").isNull() & F.col("doc_id").isNotNull()
    return marked.groupBy("part", (F.col("bits") + repeated.cast("int") * 16).alias("cell")).agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"),
        F.sum(F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"),
    )


def choices(filters: Sequence[str], orders: Sequence[Sequence[str]]) -> dict[str, list[np.ndarray]]:
    """Per question, one array for each axis: a row of pass, fail or all for each order and step."""
    asked: dict[str, list] = {"kept": [], "removed": [], "failing": [], "only": []}
    for order in orders:
        for at, this in enumerate(order):
            earlier = order[:at]
            asked["kept"].append([PASS if f in earlier or f == this else ALL for f in filters])
            asked["removed"].append([FAIL if f == this else PASS if f in earlier else ALL for f in filters])
            asked["failing"].append([FAIL if f == this else ALL for f in filters])
            asked["only"].append([FAIL if f == this else PASS for f in filters])
    return {name: list(np.array(rows, np.int64).transpose(1, 0, 2)) for name, rows in asked.items()}


def answers(counts: np.ndarray, filters: Sequence[str], orders: Sequence[Sequence[str]]) -> dict[str, np.ndarray]:
    """All measures of a batch of tensors (parts, 3, 2, ..., 2): arrays of parts by orders by steps.

    The axes stand for ``filters`` in order, 0 passes and 1 fails; the three
    tensors of a part count its documents, the good ones and the toxic ones.
    """
    axes = "abcdefgh"[: len(filters)]
    shape = (len(counts), len(orders), len(filters))
    asked = choices(filters, orders)

    def contracted(question: str, weights: slice | int) -> np.ndarray:
        formula = f"p{axes}," + ",".join(f"k{a}" for a in axes) + "->pk"
        return np.einsum(formula, counts[:, weights], *asked[question], optimize="greedy").reshape(shape)

    removed = contracted("removed", 0)
    total = np.zeros((len(counts), len(filters)), np.int64)
    which = np.array([[filters.index(f) for f in order] for order in orders])
    for k in range(len(filters)):
        total[:, k] = removed[:, which == k].sum(1)
    return {
        "kept": contracted("kept", 0),
        "removed": removed,
        "redundant": contracted("failing", 0) - removed,
        "unique_fails": contracted("only", 0),
        "good_lost": contracted("removed", 1),
        "toxic_lost": contracted("removed", 2),
        "shapley": total[:, which],
    }


def audit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "source") -> DataFrame:
    """One row per part, order of the filters and step.

    part, filter_order, step (1 to 5), kept after the step, removed at it,
    redundant (fail the step's filter, removed earlier), unique_fails (fail this
    filter only), good_lost and toxic_lost (removed here with that label), and
    shapley (removed by the step's filter, summed over all orders).
    """
    counted = cells(docs, labels, id_column, text_column, part_column)
    # at most 32 cells a part
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("cell", "n", "good", "toxic")).alias("cells"))
    orders = list(permutations(FILTERS))
    names = [*map("".join, orders)]
    measures = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    k = len(FILTERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = pa.array(np.repeat(np.arange(len(names)), k)), pa.array(names)
        for batch in batches:
            for at in range(0, batch.num_rows, PARTS_AT_ONCE):
                rows = batch.slice(at, PARTS_AT_ONCE).to_pylist()
                counts = np.zeros((len(rows), 3, 1 << k), np.int64)
                for tensor, row in zip(counts, rows, strict=True):
                    for c in row["cells"]:
                        tensor[:, c["cell"]] = c["n"], c["good"], c["toxic"]
                # bit 0 of a cell is the last axis of the reshaped counts
                tensors = counts.reshape(len(rows), 3, *[2] * k).transpose(0, 1, *range(k + 1, 1, -1))
                found = answers(tensors, FILTERS, orders)
                n = len(names) * k
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r["part"] for r in rows]).take(pa.array(np.repeat(np.arange(len(rows)), n))),
                        order[1].take(order[0]).take(pa.array(np.tile(np.arange(n), len(rows)))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows) * len(names))),
                        *(pa.array(found[m].reshape(-1)) for m in measures),
                    ],
                    names=["part", "filter_order", "step", *measures],
                )

    return parts.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{m} bigint" for m in measures))


# The same rows from the tables as they are.
SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
split AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM texts),
failing AS (
    SELECT doc_id, part,
        (len(words) < 200) :: INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words)) :: INT
        + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t)) :: INT
        + 8 * regexp_matches(t, '[#$%&*|]') :: INT
        + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) :: INT AS fails
    FROM split),
marks AS (SELECT doc_id, max(coalesce(quality = 1, false) :: INT) AS good, max(coalesce(toxic = 1, false) :: INT) AS toxic FROM labels GROUP BY doc_id),
counted AS (
    SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
    FROM failing LEFT JOIN marks USING (doc_id) GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
    SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (
    SELECT filter_order, step, (1 << (ascii(substr(filter_order, step, 1)) - 65)) AS this,
        list_sum([1 << (ascii(substr(filter_order, k, 1)) - 65) FOR k IN range(1, 6) IF k < step]) AS before
    FROM orders, (SELECT unnest(range(1, 6)) AS step)),
measured AS (
    SELECT part, filter_order, step, this,
        sum(n) FILTER (fails & this = 0 AND fails & b = 0) AS kept,
        sum(n) FILTER (fails & this <> 0 AND fails & b = 0) AS removed,
        sum(n) FILTER (fails & this <> 0 AND fails & b <> 0) AS redundant,
        sum(n) FILTER (fails = this) AS unique_fails,
        sum(good) FILTER (fails & this <> 0 AND fails & b = 0) AS good_lost,
        sum(toxic) FILTER (fails & this <> 0 AND fails & b = 0) AS toxic_lost
    FROM counted, (SELECT *, coalesce(before, 0) :: INT AS b FROM steps) GROUP BY ALL)
SELECT part, filter_order, step :: INT AS step, coalesce(kept, 0) :: BIGINT AS kept, coalesce(removed, 0) :: BIGINT AS removed,
    coalesce(redundant, 0) :: BIGINT AS redundant, coalesce(unique_fails, 0) :: BIGINT AS unique_fails,
    coalesce(good_lost, 0) :: BIGINT AS good_lost, coalesce(toxic_lost, 0) :: BIGINT AS toxic_lost,
    coalesce(sum(removed) OVER (PARTITION BY part, this), 0) :: BIGINT AS shapley
FROM measured
"""
