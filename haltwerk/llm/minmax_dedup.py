"""Near-duplicate documents by min-max hashing.

A document's set holds the hashes of its distinct shingles of ``words`` words;
a text with fewer words has its whole sequence as one shingle, and a text
without words has an empty set and no links.  Documents are linked when their
sets' Jaccard similarity reaches ``percent``, confirmed on full sets.

1. Documents with equal sets form a class; only its least id goes on.
2. Each permutation of the shingles gives two signature values, the minimum and
   the maximum, so that 64 hash evaluations per shingle make 128 values.  Each
   value of two sets agrees with the probability of their similarity, and the
   two values of one permutation vary against each other, which lowers the
   variance of an estimate against two independent permutations.
3. A band is the two values of two permutations.  A pair of similarity 0.8 shares
   none of the 32 bands with probability 5e-8.
4. Members of a band's bucket are compared with the bucket's least member, which
   is linear in the bucket, and components of the confirmed links are taken.
   No pair inside a component needs comparing, so only buckets that still hold
   several components go on: small ones compare all members of different
   components.  Members of larger ones are grouped anew by their rarest
   shingles, of which two similar sets must share one; those groups are small,
   for what nearly similar copies have in common is not rare.  Should such a
   group be large all the same, some members outside its main component are
   compared with all members of other components, twice as many each round,
   until no two members of different components of any group are left to compare.

Rows that share an id count as one document; rows with a NULL id belong to the
component of their class, are never kept, and are no component of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haltwerk.llm import packed, scratch
from haltwerk.llm.components import components, merged
from haltwerk.llm.words import Texts, mixed, ngrams, slices, split, texts_of

PERMUTATIONS = 64
BANDS = 32
SMALL = 32  # buckets up to this size compare all members of different components at once

_SEEDS = mixed(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def sets(t: Texts, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of the texts one after another, and where each text's begin (texts + 1)."""
    hashes = t.word_hash()
    gram, at = ngrams(hashes, t.doc, words)
    doc = t.doc[at]
    count = t.words_per_text()
    short = np.flatnonzero((count > 0) & (count < words))
    first = np.cumsum(count) - count
    whole = np.zeros(len(short), np.uint64)
    for i in range(words - 1):
        more = count[short] > i
        whole[more] = mixed(whole[more] * np.uint64(0x9FB21C651E98DF25) + hashes[first[short[more]] + i])
    gram, doc = np.concatenate((gram, mixed(whole + count[short].astype(np.uint64)))), np.concatenate((doc, short))
    order = np.lexsort((gram, doc))
    gram, doc = gram[order], doc[order]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1])
    gram, doc = gram[new], doc[new]
    return gram, np.searchsorted(doc, np.arange(t.n + 1))


def signatures(gram: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Minimum and maximum under each permutation, texts by 2 * PERMUTATIONS (32-bit parts of 64-bit values).

    Rows of empty sets are zero.
    """
    n = len(starts) - 1
    out = np.zeros((n, 2 * PERMUTATIONS), np.uint32)
    full = np.flatnonzero(np.diff(starts))
    if len(full):
        begin = starts[full]
        for i, seed in enumerate(_SEEDS):
            h = (gram ^ seed) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            out[full, 2 * i] = np.minimum.reduceat(h, begin) >> np.uint64(32)
            out[full, 2 * i + 1] = np.maximum.reduceat(h, begin) >> np.uint64(32)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, texts by BANDS."""
    values = signature.astype(np.uint64).reshape(len(signature), BANDS, -1)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(signature), BANDS)).copy()
    for i in range(values.shape[2]):
        key = mixed(key * np.uint64(0x9FB21C651E98DF25) + values[:, :, i])
    return key


def _signed(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, number of shingles, the set's fingerprint, and its band keys, for every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch)
            for a, b in slices(texts):
                gram, starts = sets(split(texts[a:b]), words)
                n = np.diff(starts)
                prints = []
                for salt in (1, 2):
                    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(gram + np.uint64(salt)), dtype=np.uint64)))
                    prints.append((total[starts[1:]] - total[starts[:-1]]).view(np.int64))
                keys = band_keys(signatures(gram, starts))
                packed_keys = pa.array([k.tobytes() for k in keys], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], pa.array(n.astype(np.int64)), *map(pa.array, prints), packed_keys],
                    names=["doc_id", "n_shingles", "print1", "print2", "bands"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles bigint, print1 bigint, print2 bigint, bands binary")


def _banded(classes: DataFrame) -> DataFrame:
    """A row for each class and band: key, node, size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int64)
            node = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), BANDS)))
            size = batch.column(1).take(pa.array(np.repeat(np.arange(batch.num_rows), BANDS)))
            yield pa.RecordBatch.from_arrays([pa.array(keys), node, size], names=["key", "node", "size"])

    kind = classes.schema["node"].dataType.simpleString()
    return classes.select("node", "n_shingles", "bands").mapInArrow(run, f"key bigint, node {kind}, size bigint")


def _may_link(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs a < b that can reach the similarity, each once.

    Sets of sizes m and n need ``least`` shingles in common.  If the first one
    they share (in the common order) stands behind ``rank`` others in a set,
    no more than size - rank can be.
    """
    least = F.ceil(F.lit(percent) * (F.col("size_a") + F.col("size_b")) / F.lit(100 + percent))
    enough = (F.col("size_a") - F.col("rank_a") >= least) & (F.col("size_b") - F.col("rank_b") >= least)
    return pairs.where((F.col("a") != F.col("b")) & enough).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _confirmed(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs whose full sets reach the similarity."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = docs.join(ids, docs["doc_id"] == ids["node"], "left_semi").select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = texts_of(batch)
            for a, b in slices(column):
                gram, starts = sets(split(column[a:b]), words)
                lists = [packed.ascending(gram[i:j] >> np.uint64(16)) for i, j in zip(starts[:-1], starts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(np.diff(starts)), pa.array(lists, pa.binary())], names=["node", "n", "grams"])

    full = texts.mapInArrow(read, f"node {kind}, n bigint, grams binary")
    left = full.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("grams").alias("grams_b"))
    right = full.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("grams").alias("grams_a"))
    met = pairs.join(left, "b").join(right, "a").select("a", "b", "n_a", "n_b", "grams_a", "grams_b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True)
            good, seen = [], (None, None)
            for n_a, n_b, grams_a, grams_b in rows:
                if seen[0] != grams_a:
                    seen = (grams_a, packed.from_ascending(grams_a, n_a))
                other = packed.from_ascending(grams_b, n_b)
                at = np.searchsorted(seen[1], other)
                shared = int((seen[1][np.minimum(at, n_a - 1)] == other).sum()) if n_a else 0
                good.append(shared > 0 and 100 * shared >= percent * (n_a + n_b - shared))
            yield batch.filter(pa.array(good, pa.bool_())).select([0, 1])

    return met.mapInArrow(compare, f"a {kind}, b {kind}").distinct()


def _sides(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of rows of one bucket with different components."""
    a = left.select("key", F.col("node").alias("a"), F.col("size").alias("size_a"), F.col("rank").alias("rank_a"), F.col("label").alias("label_a"))
    b = right.select("key", F.col("node").alias("b"), F.col("size").alias("size_b"), F.col("rank").alias("rank_b"), "label")
    return a.join(b, "key").where("label <> label_a").drop("key", "label", "label_a")


def _prefixes(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Rows (key, node, size, rank) for the rarest shingles of each document.

    Two sets that reach the similarity share one of the first size -
    ceil(percent * size) + 1 shingles of either, whatever order all sets are
    sorted in.  The order here is by frequency, so that what a document shares
    with few others comes first.  Frequencies are counted in a table of fixed
    size, where shingles may collide: that costs candidates, never a pair.
    """
    parts, each = 1 << 6, 1 << 14

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(parts * each, np.int64)
        for batch in batches:
            texts = texts_of(batch)
            for a, b in slices(texts):
                gram, _ = sets(split(texts[a:b]), words)
                total += np.bincount((gram % np.uint64(parts * each)).astype(np.int64), minlength=parts * each)
        rows = [packed.planes(x) for x in total.reshape(parts, each).astype(np.uint64)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(parts), pa.int32()), pa.array(rows, pa.binary())], names=["part", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(packed.numbers(c, each) for c in table.column("counts").to_pylist())
        return pa.table({"part": table.column("part")[:1], "counts": pa.array([packed.planes(total)], pa.binary())})

    kinds = "part int, counts binary"
    sums = sorted(map(tuple, docs.select("text").mapInArrow(count, kinds).groupBy("part").applyInArrow(add, kinds).collect()))  # a table of fixed size
    frequency = np.concatenate([np.zeros(0, np.uint64), *(packed.numbers(bytes(c), each) for _, c in sums)]).astype(np.int32)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch)
            for a, b in slices(texts):
                gram, starts = sets(split(texts[a:b]), words)
                size = np.diff(starts)
                doc = np.repeat(np.arange(len(size)), size)
                order = np.lexsort((gram, frequency[(gram % np.uint64(parts * each)).astype(np.int64)], doc))
                rank = np.arange(len(gram)) - starts[doc]
                kept = rank < (size - -(-percent * size // 100) + 1)[doc]
                node = batch.column(0)[a:b].take(pa.array(doc[kept]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram[order][kept].view(np.int64)), node, pa.array(size[doc[kept]]), pa.array(rank[kept])], names=["key", "node", "size", "rank"]
                )

    return docs.select("doc_id", "text").mapInArrow(first, f"key bigint, node {kind}, size bigint, rank bigint")


def _distinct_texts(docs: DataFrame) -> DataFrame:
    """One row for each id and text: pairs are confirmed once, however often their rows are repeated."""
    alike = docs.groupBy("doc_id", F.xxhash64("text").alias("_print"), F.octet_length("text").alias("_bytes"))
    return alike.agg(F.first("text").alias("text")).select("doc_id", "text")


def _connected(bands: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """node, label of the nodes that have links: components of all similar pairs."""
    least = bands.groupBy("key").agg(F.min(F.struct("node", "size")).alias("least"), F.count(F.lit(1)).alias("members"))
    least = least.where("members > 1").select("key", F.col("least.node").alias("a"), F.col("least.size").alias("size_a"))
    shared = scratch.written(bands.join(least, "key").where("node <> a").select("key", "node", "size", "a", "size_a"), "buckets")
    zero = F.lit(0).cast("long")
    first = shared.select("a", "size_a", zero.alias("rank_a"), F.col("node").alias("b"), F.col("size").alias("size_b"), zero.alias("rank_b"))
    met = shared.select(F.explode(F.array("a", "node")).alias("node")).distinct()
    docs = scratch.written(_distinct_texts(docs.join(met, docs["doc_id"] == met["node"], "left_semi")), "involved")
    labels = components(_confirmed(_may_link(first, percent), docs, words, percent))
    rows, turn = shared.select("key", "node", "size", zero.alias("rank")), 0
    # the smaller set of a similar pair shares one of even fewer of its first shingles
    leads = F.col("rank") <= F.col("size") - F.ceil(F.lit(2 * percent) * F.col("size") / F.lit(100 + percent))
    while True:
        turn += 1
        rows = rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        held = rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"), F.max(leads).alias("leads")).groupBy("key")
        held = held.agg(F.max(F.struct("n", "label")).alias("main"), F.sum("n").alias("members"), F.count(F.lit(1)).alias("labels"), F.max("leads").alias("leads"))
        rows = scratch.written(rows.join(held.where("labels > 1 and leads"), "key"), "buckets")
        if rows.isEmpty():
            return labels
        small, large = rows.where(F.col("members") <= SMALL), rows.where(F.col("members") > SMALL)
        pairs = _sides(small, small)
        if turn == 1:
            rest = large.select("node").distinct()
        else:
            # of a large group, some members outside its main component meet all members of other components
            several = F.lit(SMALL << min(turn - 2, 12))
            chosen = (F.col("label") != F.col("main.label")) & (F.pmod(F.xxhash64("node", F.lit(turn)), F.ceil((F.col("members") - F.col("main.n")) / several)) == 0)
            pairs = pairs.unionByName(_sides(large.where(chosen), large))
        pairs = scratch.written(_may_link(pairs, percent), "pairs")
        if not pairs.isEmpty():
            labels = merged(labels, _confirmed(pairs, docs, words, percent))
        if turn == 1:
            rows = scratch.written(_prefixes(docs.join(rest, docs["doc_id"] == rest["node"], "left_semi"), words, percent), "prefixes")
        else:
            rows = large.where(~chosen).select("key", "node", "size", "rank")


def near_duplicates(docs: DataFrame, words: int = 4, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row.

    component_id is the least id reachable over links, the row's own included;
    kept is doc_id = component_id.
    """
    docs = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    signed = scratch.written(_signed(docs, words), "signed")
    some = signed.where("n_shingles > 0")
    prints = ["n_shingles", "print1", "print2"]
    classes = some.groupBy(*prints).agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"))
    classes = scratch.written(classes, "classes")
    bands = _banded(classes.where("node is not null"))
    known = classes.drop("bands")
    # rows with one id in several classes are one document
    many = some.groupBy("doc_id").agg(F.min("print1").alias("low"), F.max("print1").alias("high")).where("low <> high").select("doc_id")
    same = some.join(many, "doc_id").join(known, prints).select(F.col("doc_id").alias("a"), F.col("node").alias("b")).where("a <> b").distinct()
    labels = merged(_connected(bands, docs, words, percent), same)
    known = known.join(labels, "node", "left").select(*prints, F.coalesce("label", "node").alias("component_id"))
    linked = some.select("doc_id", *prints).join(known, prints).select("doc_id", "n_shingles", "component_id")
    alone = signed.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
