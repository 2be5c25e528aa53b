"""Token counts of the documents in flat token files.

A flat file is a sequence of fixed-width ids in which an end id closes each
document; there is no index.  Files are read as blocks that know nothing of
documents.  Each block is searched for end ids in one array comparison and
reports where they are.  Documents that cross block borders are stitched by a
prefix scan over block reports: running sums of ids and of ends, and a running
maximum of the last end's place, in two levels, so that a single huge file is
no single task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from haltwerk.llm.chunked import SPAN, spaced_encoder
from haltwerk.llm.words import texts_of

BLOCK_IDS = 1 << 17
GROUP = 1024  # blocks of one stretch of the prefix scan


def flat(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    block_ids: int = BLOCK_IDS,
    id_column: str = "doc_id",
    text_column: str = "text",
    make: Callable[[str], Callable[[list[str]], list[bytes]]] = spaced_encoder,
) -> DataFrame:
    """Flat 16-bit token streams of the documents, one per partition, cut into blocks of equal length.

    Columns file, block, ids, and ``names``: ids of the documents that end in
    the block, which the scan doesn't read and which only serve to name its
    results.  NULL text is the empty text, only an end.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    ending = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make(tokenizer)
        file = TaskContext.get().partitionId()
        held = np.zeros(0, "<u2")
        names: list[tuple[int, pa.Array]] = []  # place of ends in the stream, and names
        block, base = 0, 0

        def cut(ids: np.ndarray) -> pa.RecordBatch:
            nonlocal names
            ends, name = np.concatenate([n[0] for n in names]), pa.concat_arrays([n[1] for n in names])
            here = int(np.searchsorted(ends, base + len(ids)))
            names = [(ends[here:], name[here:])]
            listed = pa.ListArray.from_arrays(pa.array([0, here], pa.int32()), name[:here])
            return pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([block], pa.int32()), pa.array([ids.tobytes()], pa.binary()), listed], names=["file", "block", "ids", "names"])

        for batch in batches:
            texts = texts_of(batch)
            for a in range(0, batch.num_rows, SPAN):
                part = [e + ending for e in encode(texts[a : a + SPAN].to_pylist())]
                ends = base + len(held) + np.cumsum([len(e) // 4 for e in part]) - 1
                names.append((ends, batch.column(0)[a : a + SPAN]))
                held = np.concatenate((held, np.frombuffer(b"".join(part), "<u4").astype("<u2")))
                while len(held) >= block_ids:
                    yield cut(held[:block_ids])
                    held, base, block = held[block_ids:], base + block_ids, block + 1
        if len(held):
            yield cut(held)

    return rows.mapInArrow(run, f"file int, block int, ids binary, names array<{kind}>")


def file_blocks(spark: SparkSession, path: str, width: int = 2, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Blocks of the flat files in a folder: file (its path), block, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw, step = memoryview(body.as_buffer()), width * block_ids
                for k, at in enumerate(range(0, len(raw), step)):
                    yield pa.RecordBatch.from_pydict({"file": [name], "block": pa.array([k], pa.int32()), "ids": pa.array([bytes(raw[at : at + step])], pa.binary())})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, block int, ids binary")


def scan(blocks: DataFrame, end_id: int, width: int = 2) -> DataFrame:
    """file, ordinal, start, n_tokens and ended of every document in the files.

    ``start`` counts ids from the beginning of the file, ``n_tokens`` leaves the
    end id out, and ``ended`` is false for what follows the last end of a file.
    """
    kind = blocks.schema["file"].dataType.simpleString()
    dtype = f"<u{width}"

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reports = []
            for body in batch.column(2).to_pylist():
                ids = np.frombuffer(body, dtype)
                reports.append((len(ids), np.flatnonzero(ids == end_id)))
            offsets = np.concatenate(([0], np.cumsum([len(r[1]) for r in reports])))
            ends = np.concatenate([np.zeros(0, np.int64), *(r[1] for r in reports)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([r[0] for r in reports], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ends, pa.int64()))],
                names=["file", "block", "n", "ends"],
            )

    found = blocks.select("file", "block", "ids").mapInArrow(search, f"file {kind}, block int, n bigint, ends array<bigint>")
    found = found.withColumn("stretch", F.floor(F.col("block") / GROUP)).withColumn("last", F.when(F.size("ends") > 0, F.element_at("ends", -1) + 1))
    earlier = Window.partitionBy("file", "stretch").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # within a stretch: ids and ends before a block, and the place behind the last end before it
    near = found.withColumn("ids_in", F.coalesce(F.sum("n").over(earlier), F.lit(0))).withColumn("docs_in", F.coalesce(F.sum(F.size("ends")).over(earlier), F.lit(0)))
    near = near.withColumn("behind_in", F.max(F.col("ids_in") + F.col("last")).over(earlier))
    whole = near.groupBy("file", "stretch").agg(
        F.sum("n").alias("n"), F.sum(F.size("ends")).alias("docs"), F.max(F.col("ids_in") + F.col("last")).alias("behind"), F.max("block").alias("final")
    )
    before = Window.partitionBy("file").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.withColumn("ids_before", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("docs_before", F.coalesce(F.sum("docs").over(before), F.lit(0)))
    whole = whole.withColumn("behind_before", F.coalesce(F.max(F.col("ids_before") + F.col("behind")).over(before), F.lit(0)))
    whole = whole.withColumn("closing", F.col("stretch") == F.max("stretch").over(Window.partitionBy("file")))
    met = near.join(whole.select("file", "stretch", "ids_before", "docs_before", "behind_before", "final", "closing"), ["file", "stretch"])
    met = met.withColumn("base", F.col("ids_before") + F.col("ids_in")).withColumn("first", F.col("docs_before") + F.col("docs_in"))
    met = met.withColumn("carry", F.coalesce(F.col("ids_before") + F.col("behind_in"), "behind_before"))
    closed = met.select("file", "base", "first", "carry", F.col("ends"), F.posexplode("ends").alias("at", "end")).select(
        "file",
        (F.col("first") + F.col("at")).alias("ordinal"),
        F.when(F.col("at") == 0, F.col("carry")).otherwise(F.col("base") + F.element_at("ends", F.greatest("at", F.lit(1))) + 1).alias("start"),
        (F.col("base") + F.col("end")).alias("end"),
        F.lit(True).alias("ended"),
    )
    edge = met.where(F.col("closing") & (F.col("block") == F.col("final"))).select(
        "file",
        (F.col("first") + F.size("ends")).alias("ordinal"),
        F.coalesce(F.col("base") + F.col("last"), F.col("carry")).alias("start"),
        (F.col("base") + F.col("n")).alias("end"),
        F.lit(False).alias("ended"),
    )
    rows = closed.unionByName(edge.where("start < end"))
    return rows.select("file", "ordinal", "start", (F.col("end") - F.col("start")).alias("n_tokens"), "ended")


def named(counts: DataFrame, streams: DataFrame) -> DataFrame:
    """Scan results with the document ids that ``flat`` noted beside the blocks."""
    inside = Window.partitionBy("file", "stretch").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    lists = streams.select("file", "block", "names", F.floor(F.col("block") / GROUP).alias("stretch"))
    sums = lists.groupBy("file", "stretch").agg(F.sum(F.size("names")).alias("n"))
    before = Window.partitionBy("file").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("file", "stretch", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    lists = lists.withColumn("first", F.coalesce(F.sum(F.size("names")).over(inside), F.lit(0))).join(sums, ["file", "stretch"])
    names = lists.select("file", (F.col("base") + F.col("first")).alias("first"), F.posexplode("names").alias("at", "doc_id"))
    return names.select("file", (F.col("first") + F.col("at")).alias("ordinal"), "doc_id").join(counts, ["file", "ordinal"])
