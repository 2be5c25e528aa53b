"""Suffix-array deduplication, spelling variants and the filter audit against plain versions of their rules."""

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from haltwerk.llm import filter_audit, queries, spelling_variants, suffix_dedup
from haltwerk.llm.acceptors import Acceptors, near_pairs
from haltwerk.llm.suffix_arrays import common_prefixes, suffix_array

FOLDER = "/root/testdata/sf0.001"


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def key(rows):
    return sorted(rows, key=repr)


# -- suffix arrays --------------------------------------------------------------


@pytest.mark.parametrize("letters", [1, 2, 4, 26])
def test_suffixes_are_sorted_in_two_stages(letters):
    draw = np.random.default_rng(letters)
    for n in (0, 1, 2, 7, 150):
        s = draw.integers(100, 100 + letters, n).astype(np.uint8)
        order, words = suffix_array(s, 50)
        text = s.tobytes()
        assert sorted(order.tolist()) == list(range(n))
        cut = [text[i : i + 50] for i in order]
        assert all(a <= b or a.startswith(b) for a, b in zip(cut, cut[1:]))
        for i, (a, b) in enumerate(zip(order[1:], order), 1):
            pair = zip(text[a : a + 50].ljust(50, b"\0"), text[b : b + 50].ljust(50, b"\0"))
            same = next((k for k, (x, y) in enumerate(pair) if x != y), 50)
            assert common_prefixes(order, words, 50)[i] == same


def test_a_long_run_of_one_byte():
    order, words = suffix_array(np.full(20_000, 120, np.uint8), 50)
    assert len(order) == 20_000 and (common_prefixes(order, words, 50)[100:-100] == 50).all()


def removed(df):
    return key([(r.doc_id, r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), bytes(r.kept)) for r in df.collect()])


@pytest.mark.parametrize("hot", [1, suffix_dedup.HOT])
def test_removed_bytes_of_whole_table(spark, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", 40_000)
    monkeypatch.setattr(suffix_dedup, "SEGMENT_BYTES", 20_000)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    found = suffix_dedup.dedup(docs, hot=hot)
    want = key(brute.earlier_strings(pairs(docs), 50))
    assert removed(found) == want and sum(r[2] for r in want) > 0
    for r in found.where("size(spans) > 0").limit(20).collect():
        assert all(0 <= a < b <= r.n_bytes for a, b in r.spans) and sum(b - a for a, b in r.spans) == r.n_bytes - len(r.kept)


def test_digest_columns(spark):
    import hashlib

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    want = [(d, n, gone, spans, hashlib.sha256(kept).hexdigest()) for d, n, gone, spans, kept in brute.earlier_strings(pairs(docs), 50)]
    assert key(map(tuple, queries.QUERIES["op11_suffix_dedup"](spark, FOLDER).collect())) == key(want)


@pytest.mark.parametrize("length", [4, 11, 50])
def test_removed_bytes_of_odd_rows(spark, odd, odd_rows, nothing, length):
    rows = [(r[0], r[1]) for r in odd_rows if r[0] not in (6, 7)]
    small = odd.where("doc_id IS NULL OR doc_id NOT IN (6, 7)")
    assert removed(suffix_dedup.dedup(small, length)) == key(brute.earlier_strings(rows, length))
    assert suffix_dedup.dedup(nothing, length).collect() == []


def test_long_texts_and_their_pieces(spark):
    draw = random.Random(3)
    long = "".join(draw.choice("abcdefgh ") for _ in range(150_000))
    rows = [(1, long), (2, "x" * 140_000), (3, long[70_000:90_000] + "?" + long[:49]), (4, "y" + "x" * 70_000), (5, long), (5, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {(r.doc_id, r.n_bytes): (r.n_bytes - len(r.kept), [tuple(x) for x in r.spans]) for r in suffix_dedup.dedup(docs).collect()}
    assert found[1, 150_000] == (0, []) and found[2, 140_000] == (0, [])
    assert found[3, 20_050] == (20_000, [(0, 20_000)])
    assert found[4, 70_001] == (70_000, [(1, 70_001)])
    assert found[5, 150_000] == (150_000, [(0, 150_000)])


# -- spelling variants ----------------------------------------------------------


def test_equal_endings_are_one_state():
    machine = Acceptors()
    q = machine.build(["tapping", "topping", "tripping"])
    assert sorted(machine.language(q)) == ["tapping", "topping", "tripping"]
    assert machine.build(["apping", "opping"]) != q and machine.build(["pping"]) == machine.arcs[machine.arcs[q]["t"]]["a"]


@pytest.mark.parametrize("letters", [3, 128])
def test_composed_pairs(letters, monkeypatch):
    monkeypatch.setattr("haltwerk.llm.acceptors.LETTERS", letters)
    draw = random.Random(5)
    for _ in range(60):
        words = sorted({"".join(draw.choice("abc") for _ in range(draw.choice((8, 9)))) for _ in range(60)})
        long, short = [w for w in words if len(w) == 9], [w for w in words if len(w) == 8]
        want = {tuple(sorted((v, w))) for v in long for w in words if v != w and brute.one_edit(v, w)}
        found = [tuple(sorted(p)) for p in near_pairs(long, short, 0)]
        assert len(found) == len(set(found)) and set(found) == want


def test_variants_of_whole_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    counts = brute.misspelt_words(pairs(docs))
    words = spelling_variants.counted_words(docs)
    assert {r.word: r.n for r in words.collect()} == counts
    want = key(brute.word_forms(counts))
    for limit in (3, spelling_variants.LIMIT):
        assert key(map(tuple, spelling_variants.variants(words, limit=limit).collect())) == want


def test_forms_roots_and_ties(spark):
    counts = {"lettera": 2, "letters": 30, "lettars": 3, "xlettars": 1, "letterz": 30, "letter": 400, "Äpfelchen": 5, "äpfelchen": 60, "abcdefg": 1, "bcdefgh": 1}
    counts |= {"x" * 600: 3, "x" * 599: 40, "x" * 200 + "y" + "x" * 399: 2}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    for limit in (1, spelling_variants.LIMIT):
        found = key(map(tuple, spelling_variants.variants(words, limit=limit).collect()))
        assert found == key(brute.word_forms(counts))
    roots = {r[0]: r[2] for r in found}
    assert roots["lettars"] == "letter" and roots["lettera"] == "letter"


def test_variants_of_odd_rows(spark, odd, odd_rows, nothing):
    counts = brute.misspelt_words([(r[0], r[1]) for r in odd_rows])
    words = spelling_variants.counted_words(odd)
    assert {r.word: r.n for r in words.collect()} == counts
    assert key(map(tuple, spelling_variants.variants(words).collect())) == key(brute.word_forms(counts))
    assert spelling_variants.variants(spelling_variants.counted_words(nothing)).collect() == []
    extra = spark.createDataFrame([("letters", 2, "set")], "word string, n long, `set` string")
    assert spelling_variants.variants(extra).count() == 1


# -- filters --------------------------------------------------------------------


def audited(docs, labels):
    return key(map(tuple, filter_audit.audit(docs, labels).collect()))


def test_audit_of_whole_table(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{n}.parquet") for n in ("documents", "labels"))
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    marks = [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()]
    assert audited(docs, labels) == key(brute.filter_orders(rows, marks))


def test_audit_of_odd_rows(spark, odd, odd_rows, nothing):
    marks = [(1, 1, 0), (2, 0, 1), (2, 1, None), (4, 1, 1), (None, 1, 1), (99, 1, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    copies = odd.unionByName(odd.withColumn("doc_id", F.col("doc_id") + 20).withColumn("source", F.lit("")))
    rows = [(r[0], r[1], r[3]) for r in odd_rows]
    rows += [(None if d is None else d + 20, t, "") for d, t, _ in rows]
    assert audited(copies, labels) == key(brute.filter_orders(rows, marks))
    assert audited(copies, labels.where("false")) == key(brute.filter_orders(rows, []))
    assert audited(nothing, labels) == []
    clash = odd.withColumn("n", F.lit(1)).withColumn("print", F.lit("x")).withColumn("good", F.lit(2)).withColumn("cell", F.lit(3))
    assert audited(clash, labels.withColumn("n", F.lit(1))) == audited(odd, labels)


def test_tensor_questions():
    draw = np.random.default_rng(2)
    counts = draw.integers(0, 9, (2, 3, 2, 2, 2))
    found = filter_audit.answers(counts, "ABC", ["ABC", "CBA"])
    assert (found["kept"][:, 0, 2] == counts[:, 0, 0, 0, 0]).all()
    assert (found["removed"][:, 1, 0] == counts[:, 0, :, :, 1].sum((1, 2))).all()
    assert (found["redundant"][:, 0, 1] == counts[:, 0, 1, 1].sum(1)).all()
    assert (found["toxic_lost"][:, 0, 0] == counts[:, 2, 1].sum((1, 2))).all()
