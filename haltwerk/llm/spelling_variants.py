"""Groups of spelling variants: words one edit apart, found by composing acceptors.

Two words are near if one inserted, deleted or replaced letter (code point)
turns one into the other.  A word's form is its near word with the largest
count, if that count is at least ``ratio`` times the word's own; its root is
where following the forms ends.

No acceptor holds a whole vocabulary.  Near words of which the longer one has m
letters share the first half of these or the second, whichever the edit is not
in.  So each word goes, as one of the longer and as one of the shorter words, to
the words with the same beginning, and reversed to those with the same ending.
Each such set is a partition by initial state: the state that the shared letters
lead to.  In it the rest of the words becomes a minimised acceptor, which is
composed with the one-edit transducer and the acceptor again (``acceptors``), and
the accepted pairs are those that no other set gives.

A set of more than ``LIMIT`` words is dealt on by the place of the edit: words
that agree in all letters but the one at that place.  Such a set has no more
words than there are letters, and one.  No set is dropped or cut.

What is shuffled are counted words, never occurrences: each task adds up its
texts' words first.  Pairs become counts and best forms where they are found.

Results for odd rows: NULL texts have no words; a NULL id counts as the empty
string where ids matter; rows that share an id are all counted.  An empty table
has no words.  Only the id and the text column are read.  Words of any length are
compared whole.  Of equally frequent near words the smallest in code-point order
is the form.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haltwerk.llm import scratch
from haltwerk.llm.acceptors import near_pairs

LIMIT = 100_000  # words of one set
HELD = 500_000  # distinct words a task adds up before it passes them on
LETTERS = "A-Za-zÀ-ÿ"


def counted_words(docs: DataFrame, min_letters: int = 7, min_count: int = 2, one_in: int = 31, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Words of all texts with their counts: word, n.

    A word is a longest run of Latin letters with A-Z lowered.  Where the CRC-32
    of ``<id>:<word>`` is a multiple of ``one_in``, the word loses the letter at
    that CRC modulo its length, so that a corpus has misspellings to find; 0
    leaves all words as they are.
    """
    runs = re.compile(f"[{LETTERS}]{{{min_letters},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = defaultdict(int)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                own: dict[str, int] = defaultdict(int)
                for w in runs.findall(text.encode().lower().decode()):
                    own[w] += 1
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for w, n in own.items():
                    if one_in and not (h := zlib.crc32(w.encode(), start)) % one_in:
                        at = h % len(w)
                        w = w[:at] + w[at + 1 :]
                        if len(w) < min_letters:
                            continue
                    held[w] += n
            if len(held) > HELD:
                yield _counts(held)
                held.clear()
        yield _counts(held)

    found = docs.select(id_column, F.col(text_column).cast("string")).mapInArrow(run, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _counts(held: dict[str, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])


def _dealt(words: DataFrame, limit: int) -> DataFrame:
    """Each word in its sets: set (a hash), back (reversed), size m, start (shared letters), at (place of the edit, or NULL), w, n."""
    length = F.char_length("word")
    ways = []
    for longer in (length, length + 1):
        half = F.floor(longer / 2).cast("int")
        ways.append(F.struct(F.lit(False).alias("back"), longer.alias("m"), half.alias("start"), F.col("word").alias("w")))
        ways.append(F.struct(F.lit(True).alias("back"), longer.alias("m"), (longer - half).alias("start"), F.reverse("word").alias("w")))
    rows = words.select(F.explode(F.array(*ways)).alias("way"), "n").select("way.*", "n")
    rows = rows.withColumn("set", F.xxhash64("back", "m", F.expr("substring(w, 1, start)"))).withColumn("at", F.lit(None).cast("int"))
    large = rows.groupBy("set").count().where(F.col("count") > limit).select("set", F.lit(True).alias("large"))
    large = scratch.written(large, "large-sets")
    if large.isEmpty():
        return rows
    # fewer than four times the words by the limit
    marked = rows.join(F.broadcast(large), "set", "left")
    last = F.col("m") - 1
    places = marked.where("large").withColumn("at", F.explode(F.sequence(F.col("start"), last)))
    others = F.when(F.char_length("w") == F.col("m"), F.concat(F.expr("substring(w, 1, at)"), F.expr("substring(w, at + 2)"))).otherwise(F.col("w"))
    places = places.withColumn("set", F.xxhash64("back", "m", "at", others))
    return marked.where("large IS NULL").unionByName(places).drop("large")


_NEAR = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best", pa.struct([("less", pa.int64()), ("form", pa.string())]))])


def _composed(rows: list[tuple[bool, int, int, int | None, str, int]]) -> Iterator[tuple[str, int, dict]]:
    """Of one set's words: each one that has near words here, their number, and the best."""
    kinds = defaultdict(dict)  # one kind, unless two sets have the same hash
    for back, m, start, at, w, n in rows:
        kinds[back, m, start if at is None else at, at is None][w] = n
    for (back, m, start, whole), counts in kinds.items():
        groups: dict[str, tuple[list, list]] = defaultdict(lambda: ([], []))
        for w in sorted(counts):
            groups[w[:start]][m - len(w)].append(w)
        half = m // 2
        near: dict[str, list[str]] = defaultdict(list)
        for long, short in groups.values():
            for v, w in near_pairs(long, short, start):
                if back and v[::-1][:half] == w[::-1][:half]:
                    continue  # found by their beginning
                if not whole and len(v) != len(w) and not _first_place(v, w, start, m - half if back else half):
                    continue
                near[v].append(w)
                near[w].append(v)
        for v, others in near.items():
            n, form = min((-counts[w], w[::-1] if back else w) for w in others)
            yield v[::-1] if back else v, len(others), {"less": n, "form": form}


def _first_place(long: str, short: str, at: int, start: int) -> bool:
    """Whether ``at`` is the first of the places, from ``start`` on, whose letter can be the deleted one."""
    return long[:at] + long[at + 1 :] == short and (at == start or long[at - 1] != long[at])


def near_words(words: DataFrame, limit: int = LIMIT) -> DataFrame:
    """For each word with near words: word, n_near, best (minus its count, and the form)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        last = None
        for batch in batches:
            sets = batch.column(0).to_numpy()
            values = list(zip(*(batch.column(k).to_pylist() for k in range(1, 7)), strict=True))
            cuts = [0, *(np.flatnonzero(sets[1:] != sets[:-1]) + 1).tolist(), len(sets)]
            out = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a < b:
                    if sets[a] != last:
                        out += _composed(rows) if len(rows) > 1 else ()
                        rows, last = [], sets[a]
                    rows += values[a:b]
            yield _batch(out)
        yield _batch(list(_composed(rows)))

    dealt = _dealt(words, limit).select("set", "back", "m", "start", "at", "w", "n")
    found = dealt.repartition("set").sortWithinPartitions("set").mapInArrow(run, "word string, n_near bigint, best struct<less bigint, form string>")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _NEAR, strict=True)], schema=_NEAR)


def roots(forms: DataFrame) -> DataFrame:
    """Where following ``form`` from each word ends: word, root.

    Counts grow by ``ratio`` at each step, so chains are short; each round
    doubles the steps taken.
    """
    ends = scratch.written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        taken = ends.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        taken = scratch.written(taken, "roots")
        if taken.where("moved").isEmpty():
            return taken.select("word", "root")
        ends = taken.select("word", "root")


def variants(words: DataFrame, ratio: int = 10, limit: int = LIMIT) -> DataFrame:
    """Per word of a table of distinct words and counts (word, n): word, form, root, n, n_near, form_n."""
    counted = scratch.written(words.select("word", "n"), "words")
    joined = counted.join(near_words(counted, limit), "word", "left")
    formed = F.col("best.less") * -1 >= F.col("n") * ratio
    rows = scratch.written(
        joined.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(formed, F.col("best.form")).alias("form"), F.when(formed, -F.col("best.less")).alias("form_n")
        ),
        "forms",
    )
    return rows.join(roots(rows.where("form IS NOT NULL")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
