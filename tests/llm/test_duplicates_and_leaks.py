import random
import re

import brute
import numpy as np
import pyarrow as pa

from haltwerk.llm import components, decontaminate, minmax_dedup
from haltwerk.llm.words import mixed, slices, split


def check_components(frame, rows, words=4):
    got = {r.doc_id: r for r in minmax_dedup.near_duplicates(frame, words).collect() if r.doc_id is not None}
    sets = {d: brute.shingles(t, words) for d, t in rows if d is not None}
    want = brute.components(sets, 80)
    assert {d: r.component_id for d, r in got.items()} == want
    assert all(r.n_shingles == len(sets[d]) and r.kept == (want[d] == d) for d, r in got.items())


def test_components_equal_brute_force(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check_components(frame, [(r.doc_id, r.text) for r in frame.collect()])


def test_odd_and_no_rows(odd, odd_rows, nothing):
    check_components(odd, [(r[0], r[1]) for r in odd_rows])
    assert minmax_dedup.near_duplicates(odd).count() == 13
    assert minmax_dedup.near_duplicates(nothing).collect() == []


def test_families_of_almost_similar_copies(spark, monkeypatch):
    """Copies that differ from each other around the threshold: large buckets with several components."""
    monkeypatch.setattr(minmax_dedup, "SMALL", 6)
    draw = random.Random(5)
    base = [f"w{draw.randrange(400)}" for _ in range(150)]
    rows = []
    for i in range(50):
        text = list(base)
        for _ in range(draw.choice([2, 4, 5, 6])):
            text[draw.randrange(150)] = f"n{draw.randrange(10**6)}"
        rows.append((i, " ".join(text)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    check_components(frame, rows)


def test_one_id_with_two_texts_links_both(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    frame = spark.createDataFrame([(1, a), (2, a), (2, b), (3, b)], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in minmax_dedup.near_duplicates(frame).collect()} == {(1, 1), (2, 1), (3, 1)}


def test_signatures_estimate_similarity():
    grams = mixed(np.arange(3000, dtype=np.uint64))
    left, right = np.sort(grams[:2000]), np.sort(grams[1000:])
    both = np.concatenate((left, right))
    a, b = minmax_dedup.signatures(both, np.array([0, 2000, 4000]))
    assert abs((a == b).mean() - 1 / 3) < 0.12


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 130)] + [(5, k) for k in range(6, 20)] + [(40, 41), (41, 40)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 131)) and all(got[k] == 5 for k in range(5, 20)) and got[41] == 40
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


ITEMS = [(1, "a quick brown fox jumps over the lazy dog near the river bank at dawn today"), (2, None), (3, ""), (4, "two words"), (5, "alpha beta gamma delta epsilon zeta eta theta")]


def items_of(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


def test_copies_edited_and_clean(spark):
    item = ITEMS[0][1].split()
    edited = " ".join(w if i % 5 else f"other{i}" for i, w in enumerate(item))
    put_in = " ".join(item[:6] + ["really", "truly"] + item[6:])
    noise = " ".join(f"n{i}" for i in range(300))
    docs = [(1, f"{noise} {ITEMS[0][1].upper()}! {noise}"), (2, f"{noise} {put_in} {noise}"), (3, f"{edited} {noise}"), (4, noise), (5, "the lazy dog near " + noise), (6, None), (None, ITEMS[4][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.matches(frame, items_of(spark)).collect()}
    assert set(got) == {(1, 1), (2, 1), (3, 1), (None, 5)}
    assert got[1, 1].score == 1 and (got[1, 1].first_word, got[1, 1].past_word) == (300, 300 + len(item))
    assert {r.doc_id for r in decontaminate.clean(frame, items_of(spark)).collect()} == {4, 5, 6}


def test_blocks_of_items_and_frequent_copies(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 2)
    docs = spark.createDataFrame([(i, f"x{i} {ITEMS[0][1]} y{i}") for i in range(200)], "doc_id long, text string")
    assert decontaminate.matches(docs, items_of(spark)).count() == 200


def test_many_equal_edited_copies(spark):
    """Found in 200 documents as in one, though the words replaced leave few seeds, all of them frequent."""
    item = ITEMS[0][1].split()
    for edits in ((4, 9), (2, 7, 12)):  # 20 % of 15 words: 6 of 13 seeds gone and more
        copy = " ".join("other" if i in edits else w for i, w in enumerate(item))
        docs = spark.createDataFrame([(i, f"x{i} {copy} y{i}") for i in range(200)], "doc_id long, text string").repartition(3)
        assert decontaminate.matches(docs, items_of(spark)).count() == 200
        assert decontaminate.clean(docs, items_of(spark)).count() == 0


def test_frequent_phrases_are_no_leaks(spark):
    docs = spark.createDataFrame([(i, f"x{i} the lazy dog near the river bank y{i}") for i in range(200)], "doc_id long, text string")
    assert decontaminate.matches(docs, items_of(spark)).count() == 0


def test_every_item_against_every_document(spark):
    """All pairs by alignment of the whole texts, where they share a seed."""
    folder = "/root/testdata/sf0.001"
    docs, items = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id): round(r.score, 9) for r in decontaminate.matches(docs, items).collect()}
    word = lambda t: re.findall(r"[^\x00-/:-@\[-`{-\x7f]+", (t or "").encode().lower().decode())
    texts = {r.doc_id: word(r.text) for r in docs.collect()}
    asked = {r.item_id: word(r.text) for r in items.collect()}
    number = {w: i for i, w in enumerate({w for x in (*texts.values(), *asked.values()) for w in x})}
    runs = lambda w: {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
    seeds, want = {k: runs(w) for k, w in asked.items()}, {}
    for d, text in texts.items():
        held = runs(text)
        for k, item in asked.items():
            if seeds[k] & held:
                score = decontaminate.align(np.array([number[w] for w in item]), np.array([number[w] for w in text]))[0] / (2 * len(item))
                if score >= 0.5:
                    want[d, k] = round(score, 9)
    assert got == want and want


def test_thousands_of_items_with_a_stock_phrase(spark):
    """Frequent seeds cost a sum of words for each item, not an alignment, and lose nothing."""
    import time

    stock = "which one of the following is true"
    items = spark.createDataFrame([(k, f"{stock} " + " ".join(f"i{k}x{j}" for j in range(12))) for k in range(3_000)], "item_id long, text string")
    leak = f"{stock} " + " ".join(f"i77x{j}" for j in range(12))
    texts = [(d, " ".join([stock, f"a{d}", stock, f"b{d}", *(["and", leak] if d == 5 else [])])) for d in range(40)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert [(r.doc_id, r.item_id, r.score) for r in decontaminate.matches(docs, items).collect()] == [(5, 77, 1.0)]
    (block,) = decontaminate._blocks(items, "item_id", "text", 3)
    marked = decontaminate.counted(docs, block, 3)
    t = decontaminate._words(pa.array([x for _, x in texts]))
    began = time.process_time()
    found = decontaminate._matched(t, marked, 3, 0.5)
    assert time.process_time() - began < 2
    assert [f[:2] for f in found] == [(5, block.ids.to_pylist().index(77))]
    assert not marked.rare.all() and marked.rare.any()


def test_rare_and_frequent_seeds_find_the_same(spark):
    folder = "/root/testdata/sf0.001"
    docs, items = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "benchmark"))
    (block,) = decontaminate._blocks(items, "item_id", "text", 3)
    t = decontaminate._words(pa.array([r.text or "" for r in docs.collect()]))
    assert decontaminate._matched(t, decontaminate.counted(docs, block, 3), 3, 0.5) == decontaminate._matched(t, block, 3, 0.5)


def test_reach_is_no_less_than_the_score():
    draw = random.Random(3)
    for _ in range(300):
        a = np.array([draw.randrange(8) for _ in range(draw.randrange(1, 12))])
        b = np.array([draw.randrange(8) for _ in range(draw.randrange(1, 8))])
        assert decontaminate._reach(np.isin(a, b)) >= brute.smith_waterman(list(a), list(b))


def test_leaks_in_odd_and_no_rows(spark, odd, nothing):
    assert decontaminate.matches(odd, items_of(spark)).collect() == []
    assert decontaminate.clean(odd, items_of(spark)).count() == 13
    assert decontaminate.clean(odd, items_of(spark)).columns == odd.columns
    assert decontaminate.matches(nothing, items_of(spark)).collect() == []
    assert decontaminate.clean(odd, items_of(spark).where("false")).count() == 13


def test_alignment_equals_the_full_table():
    draw = random.Random(2)
    for _ in range(60):
        a = [draw.randrange(4) for _ in range(draw.randrange(1, 12))]
        b = [draw.randrange(4) for _ in range(draw.randrange(0, 25))]
        score, start, end = decontaminate.align(np.array(a), np.array(b, int))
        assert score == brute.smith_waterman(a, b)
        assert brute.smith_waterman(a, b[start:end]) == score


def test_words_equal_a_regex():
    texts = ["", " a  b\n\tc ", "Zoë 你 好", "x" * 3000, None, "one\x0btwo\x0cthree\x1cfour five", "tail "]
    column = pa.array(texts, pa.string()).fill_null("")
    seen = {}
    for a, b in slices(column, 10):
        t = split(column[a:b])
        h = t.word_hash()
        for k in range(t.n):
            w = brute.words(texts[a + k])
            assert len(w) == int((t.doc == k).sum())
            for word, value in zip(w, h[t.doc == k], strict=True):
                assert seen.setdefault(word, value) == value
    assert len(set(seen.values())) == len(seen)
