"""Test items in training documents: n-gram seeds, then local alignment.

1. Seeds.  Runs of ``seed_words`` words of the items are looked up in every
   document.  The documents that hold each seed are counted first; an item's
   *rare* seeds are those in no more documents than its median seed.  A rare
   seed joins its document to the item at once.  Other seeds, phrases that
   everybody uses, join a document only if it has enough of the item's words for
   an alignment at ``threshold``: one sum over the item's words, with no loss, as
   a document without them can't reach it.  So no seed is left out for being
   frequent, and what is found in a document depends on it and the items alone.
2. Join.  Seeds join passages to items: seeds of one item that lie on about the
   same diagonal of a document give one passage, the item's length and a margin
   wide.  A passage that lacks so many of the item's words that no alignment can
   reach ``threshold`` is dropped, which is how phrases that everybody uses go.
3. Alignment.  Smith-Waterman scores item against passage, word by word: a match
   2, a mismatch or a gap -1.  ``score`` is the best local alignment's share of
   the item's score against itself; a copy with words replaced, left out or put
   in loses some of it, and text that shares a phrase stays far below
   ``threshold``.

Words are longest runs of letters and digits, A-Z folded.  Items are the query
set: they are taken in blocks of bounded size, each block travels to all
documents, and documents are neither shuffled nor collected.  Of equally good
passages of a document the one with the lower diagonal is reported.  Items with fewer
words than a seed match nothing; neither do NULL and empty texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haltwerk.llm import packed
from haltwerk.llm.words import Texts, ngrams, slices, split, texts_of

SEED_WORDS = 3
THRESHOLD = 0.5
BLOCK_ITEMS = 5_000
BLOCK_BYTES = 8 << 20
MATCH, MISS, GAP = 2, -1, -1

_BREAKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def _words(column: pa.Array) -> Texts:
    return split(column, spaces=_BREAKS)


@dataclass(frozen=True)
class Items:
    """A block of items, with their word hashes, and their seeds in ascending order."""

    ids: pa.Array
    words: list[np.ndarray]
    seeds: np.ndarray  # hash, ascending
    owner: np.ndarray  # item of each seed
    place: np.ndarray  # first word of each seed
    vocabulary: np.ndarray  # word hashes of all items, ascending
    word_ids: list[np.ndarray]  # the items' words as places in the vocabulary
    rare: np.ndarray | None = None  # of seeds; all if they were not counted


def _items(table: pa.Table, seed_words: int) -> Items:
    texts = table.column("text").combine_chunks() if table.num_rows else pa.array([], pa.string())
    t = _words(texts.fill_null(""))
    hashes = t.word_hash()
    seeds, at = ngrams(hashes, t.doc, seed_words)
    first = np.searchsorted(t.doc, np.arange(t.n + 1))
    order = np.argsort(seeds, kind="stable")
    owner = t.doc[at[order]]
    vocabulary, ids = np.unique(hashes, return_inverse=True)
    spans = list(zip(first[:-1], first[1:], strict=True))
    return Items(
        table.column("item_id").combine_chunks(), [hashes[i:j] for i, j in spans], seeds[order], owner, at[order] - first[owner], vocabulary, [ids[i:j] for i, j in spans]
    )


def _blocks(items: DataFrame, id_column: str, text_column: str, seed_words: int) -> Iterator[Items]:
    rows = items.select(F.col(id_column).alias("item_id"), F.col(text_column).alias("text"))
    n, size = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    blocks = max(1, math.ceil(n / BLOCK_ITEMS), math.ceil((size or 0) / BLOCK_BYTES))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    for k in range(blocks):
        table = rows.where(F.col("block") == k).select("item_id", "text").toArrow()
        made = _items(table.sort_by("item_id"), seed_words)
        if len(made.seeds):
            yield made


def _found(seeds: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of grams that are seeds, and the first seed each equals."""
    at = np.minimum(np.searchsorted(seeds, gram), len(seeds) - 1)
    hit = np.flatnonzero(seeds[at] == gram)
    return hit, at[hit]


COUNT_PARTS = 64


def counted(docs: DataFrame, block: Items, seed_words: int) -> Items:
    """The block with its rare seeds marked, from the number of documents that hold each seed.

    Tasks add up their documents; a table with one count per seed of the block
    is all that reaches the driver.
    """
    kinds = np.unique(block.seeds)
    edges = np.linspace(0, len(kinds), COUNT_PARTS + 1).astype(int)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(kinds), np.uint64)
        for batch in batches:
            texts = texts_of(batch)
            for a, b in slices(texts):
                t = _words(texts[a:b])
                gram, at = ngrams(t.word_hash(), t.doc, seed_words)
                hit, seed = _found(kinds, gram)
                held = np.unique(t.doc[at[hit]] * len(kinds) + seed)
                total += np.bincount(held % len(kinds), minlength=len(kinds)).astype(np.uint64)
        rows = [packed.planes(total[i:j]) for i, j in zip(edges[:-1], edges[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(COUNT_PARTS), pa.int32()), pa.array(rows, pa.binary())], names=["part", "counts"])

    def add(table: pa.Table) -> pa.Table:
        k = table.column("part")[0].as_py()
        total = sum(packed.numbers(c, int(edges[k + 1] - edges[k])) for c in table.column("counts").to_pylist())
        return pa.table({"part": table.column("part")[:1], "counts": pa.array([packed.planes(total)], pa.binary())})

    shape = "part int, counts binary"
    rows = {r["part"]: bytes(r["counts"]) for r in docs.select("text").mapInArrow(count, shape).groupBy("part").applyInArrow(add, shape).collect()}
    sums = [packed.numbers(rows[k], int(edges[k + 1] - edges[k])) if k in rows else np.zeros(edges[k + 1] - edges[k], np.uint64) for k in range(COUNT_PARTS)]
    of_seed = np.concatenate(sums)[np.searchsorted(kinds, block.seeds)].astype(np.int64)
    order = np.lexsort((of_seed, block.owner))
    owner = block.owner[order]
    first = np.searchsorted(owner, np.arange(len(block.words) + 1))
    middle = of_seed[order[np.minimum((first[:-1] + first[1:] - 1) // 2, len(order) - 1)]]
    return replace(block, rare=of_seed <= middle[block.owner])


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman: the best score, and the passage words it spans (first, one past the last).

    Rows of the score table are computed at once; a gap along a row is a running
    maximum.  The span is read off by alignment backwards from the best cell.
    """
    best, end, upto = _best(item, passage)
    if best <= 0:
        return 0, 0, 0
    back, length, _ = _best(item[:upto][::-1], passage[:end][::-1])
    return best, end - length, end


def _best(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    n = len(passage)
    slope = np.arange(n + 1) * GAP
    row = np.zeros(n + 1, np.int64)
    top, end, upto = 0, 0, 0
    for i, word in enumerate(item, 1):
        new = np.zeros(n + 1, np.int64)
        new[1:] = np.maximum(np.maximum(row[:-1] + np.where(passage == word, MATCH, MISS), row[1:] + GAP), 0)
        row = np.maximum.accumulate(new - slope) + slope
        k = int(row.argmax())
        if row[k] > top:
            top, end, upto = int(row[k]), k, i
    return top, end, upto


def _reach(present: np.ndarray) -> int:
    """The most an alignment can score when only the marked words of the item occur in the passage.

    Every item word within the aligned span gives a match at most, and costs a mismatch or a gap if the passage lacks it.
    """
    running = np.concatenate(([0], np.cumsum(np.where(present, MATCH, max(MISS, GAP)))))
    return int((running - np.minimum.accumulate(running)).max())


def _passages(doc: np.ndarray, item: np.ndarray, diagonal: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hits of one document and item whose diagonals follow each other closely, as one passage each: doc, item, low, high diagonal."""
    order = np.lexsort((diagonal, item, doc))
    doc, item, diagonal = doc[order], item[order], diagonal[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (np.diff(diagonal) > np.maximum(lengths[item[1:]] // 4, 2))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], item[first], diagonal[first], diagonal[last]


def _worth_a_look(
    doc: np.ndarray, owner: np.ndarray, rare: np.ndarray, first: np.ndarray, word_id: np.ndarray, items: Items, seen: np.ndarray, threshold: float
) -> np.ndarray:
    """Hits of the pairs of text and item that have a rare seed, or enough of the item's words in the text.

    The best alignment's matches are words of the item that the text has, so
    these must make ``threshold`` of the item's own score alone.
    """
    pair = doc.astype(np.int64) * len(items.words) + owner
    good = [np.unique(pair[rare])]
    other = np.setdiff1d(pair, good[0])
    d, k = other // len(items.words), other % len(items.words)
    cuts = [*np.flatnonzero(np.diff(d, prepend=-1)).tolist(), len(d)]
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        own = word_id[first[d[i]] : first[d[i] + 1]]
        seen[own] = True
        seen[-1] = False  # words of no item
        some = [items.word_ids[x] for x in k[i:j].tolist()]
        sizes = np.array([len(x) for x in some])
        present = np.add.reduceat(seen[np.concatenate(some)].astype(np.int64), np.cumsum(sizes) - sizes)
        seen[own] = False
        good.append(other[i:j][present >= threshold * sizes])
    good = np.concatenate(good)
    return np.isin(pair, good)


def _matched(t: Texts, items: Items, seed_words: int, threshold: float) -> list[tuple[int, int, float, int, int]]:
    """Text, item, score and word span of the best alignment of each text and item above the threshold."""
    hashes = t.word_hash()
    gram, at = ngrams(hashes, t.doc, seed_words)
    hit, seed = _found(items.seeds, gram)
    if not len(hit):
        return []
    last = np.searchsorted(items.seeds, gram[hit], "right")
    many = last - seed  # seeds with this hash: several items may share one
    which = np.repeat(seed - np.cumsum(many) + many, many) + np.arange(many.sum())
    at = np.repeat(at[hit], many)
    first = np.searchsorted(t.doc, np.arange(t.n + 1))
    doc = t.doc[at]
    lengths = np.array([len(w) for w in items.words])
    word_id = np.minimum(np.searchsorted(items.vocabulary, hashes), len(items.vocabulary) - 1)
    word_id[items.vocabulary[word_id] != hashes] = len(items.vocabulary)
    seen = np.zeros(len(items.vocabulary) + 1, bool)
    owner = items.owner[which]
    if items.rare is not None:
        keep = _worth_a_look(doc, owner, items.rare[which], first, word_id, items, seen, threshold)
        at, which, doc, owner = at[keep], which[keep], doc[keep], owner[keep]
        if not len(at):
            return []
    found: dict[tuple[int, int], tuple[float, int, int]] = {}
    for d, k, low, high in zip(*_passages(doc, owner, at - first[doc] - items.place[which], lengths), strict=True):
        item = items.words[k]
        margin = len(item) // 4 + 2
        a, b = max(low - margin, 0), high + len(item) + margin
        span = slice(first[d] + a, min(first[d] + b, first[d + 1]))
        seen[word_id[span]] = True
        present = seen[items.word_ids[k]]
        seen[word_id[span]] = False
        if _reach(present) / (MATCH * len(item)) < threshold:
            continue
        score, start, end = align(item, hashes[span])
        share = score / (MATCH * len(item))
        old = found.get((d, k))
        if share >= threshold and (old is None or share > old[0]):
            found[(d, k)] = (share, a + start, a + end)
    return [(d, k, *v) for (d, k), v in sorted(found.items())]


def matches(
    docs: DataFrame,
    items: DataFrame,
    threshold: float = THRESHOLD,
    seed_words: int = SEED_WORDS,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """doc_id, item_id, score, first_word and past_word of the best alignment of every document and item at or above the threshold."""
    docs = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kinds = docs.schema["doc_id"].dataType.simpleString(), items.schema[item_column].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, score double, first_word bigint, past_word bigint"
    out = docs.sparkSession.createDataFrame([], schema)
    for block in _blocks(items, item_column, item_text, seed_words):
        block = counted(docs, block, seed_words)

        def run(batches: Iterator[pa.RecordBatch], block: Items = block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = texts_of(batch)
                for a, b in slices(texts):
                    rows = _matched(_words(texts[a:b]), block, seed_words, threshold)
                    if rows:
                        doc, item, score, start, end = zip(*rows, strict=True)
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0)[a:b].take(pa.array(doc)), block.ids.take(pa.array(item)), pa.array(score), pa.array(start, pa.int64()), pa.array(end, pa.int64())],
                            names=["doc_id", "item_id", "score", "first_word", "past_word"],
                        )

        out = out.unionByName(docs.mapInArrow(run, schema))
    return out


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, seed_words: int = SEED_WORDS) -> DataFrame:
    """The documents that hold no item, row by row, with all their columns."""
    at, texts = docs.columns.index("text"), docs.select("text")
    for block in _blocks(items, "item_id", "text", seed_words):
        block = counted(texts, block, seed_words)

        def run(batches: Iterator[pa.RecordBatch], block: Items = block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(at).fill_null("")
                keep = np.ones(batch.num_rows, bool)
                for a, b in slices(texts):
                    for d, *_ in _matched(_words(texts[a:b]), block, seed_words, threshold):
                        keep[a + d] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
