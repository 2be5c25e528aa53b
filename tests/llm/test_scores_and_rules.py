import brute
import numpy as np
import pytest

from haltwerk.llm import deleted_interpolation as di
from haltwerk.llm import quality_classifier, quality_rules, weak_labels

SF = "/root/testdata/sf0.001"


def docs_of(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def compare_scores(frame, rows):
    model = di.fit(frame)
    want = sorted(brute.language_scores(rows, model.weights), key=lambda r: (r[0] is not None, r[0], r[2]))
    got = sorted(map(tuple, di.score(frame).collect()), key=lambda r: (r[0] is not None, r[0], r[2]))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    np.testing.assert_allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9, atol=1e-9)


def test_scores_equal_brute_force(spark):
    frame = docs_of(spark)
    compare_scores(frame, [(r.doc_id, r.text) for r in frame.collect()])


def test_scores_of_odd_rows(spark, odd, odd_rows):
    compare_scores(odd, [(r[0], r[1]) for r in odd_rows])


def test_scores_in_many_groups_and_ranges(spark, monkeypatch):
    monkeypatch.setattr(di, "GROUP_BYTES", 20_000)
    monkeypatch.setattr(di, "RANGE_BYTES", 50_000)
    frame = docs_of(spark)
    compare_scores(frame, [(r.doc_id, r.text) for r in frame.collect()])


def test_scores_of_no_rows(nothing):
    assert di.score(nothing).collect() == []


def test_weights_are_distributions_and_follow_the_data():
    cells = np.array([(5, 4, 20, 1000), (5, -1, 20, 10), (3, -1, 8, 500)])
    w = di.mixture(cells, kinds=10**6)
    np.testing.assert_allclose(w.sum(1), 1)
    assert w[5, 0] > 0.9 and w[3, 1] > 0.9 and w[0, 0] == 0


def test_base_measures(spark, odd, odd_rows):
    for frame, rows in ((docs_of(spark), None), (odd, odd_rows)):
        rows = rows or [(r.doc_id, r.text) for r in frame.collect()]
        got = quality_rules.apply_rules(frame).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
        key = lambda r: (r[0] is not None, *r)
        assert sorted(map(tuple, got), key=key) == sorted(((r[0], *brute.base_measures(r[1])) for r in rows), key=key)


@pytest.mark.parametrize("operator", [quality_rules.apply_rules, quality_classifier.classify, quality_rules.good, quality_classifier.good])
def test_quality_of_odd_and_no_rows(odd, nothing, operator):
    frame = operator(odd)
    rows = frame.collect()
    assert operator(nothing).collect() == []
    by = {r.doc_id: r for r in rows}
    if "kept" in frame.columns:
        assert len(rows) == 13 and not by[3].kept and not by[4].kept and not by[5].kept
        assert by[1].kept == by[2].kept
    else:
        assert frame.columns == odd.columns and not {3, 4, 5} & set(by)


def test_rules_agree_row_by_row(spark):
    frame = docs_of(spark)
    kept = {r.doc_id for r in quality_rules.apply_rules(frame).where("kept").collect()}
    assert kept == {r.doc_id for r in quality_rules.good(frame).collect()}
    kept = {r.doc_id for r in quality_classifier.classify(frame).where("kept").collect()}
    assert kept == {r.doc_id for r in quality_classifier.good(frame).collect()}


def test_quality_against_labels(spark):
    frame, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rules = quality_rules.apply_rules(frame).join(labels, "doc_id").where("not base_failed").collect()
    assert all(r.kept for r in rows_with(rules, 1)) and np.mean([not r.kept for r in rows_with(rules, 0)]) > 0.9
    scores = quality_classifier.classify(frame).join(labels, "doc_id").collect()
    assert np.mean([r.kept for r in rows_with(scores, 1)]) > 0.97 and np.mean([not r.kept for r in rows_with(scores, 0)]) > 0.95


def rows_with(rows, quality):
    return [r for r in rows if r.quality == quality]


def test_label_model_recovers_accuracies():
    draw = np.random.default_rng(3)
    good = draw.random(20_000) < 0.8
    g, b, cast = np.array([0.99, 0.97, 0.95, 0.98]), np.array([0.5, 0.7, 0.3, 0.6]), 0.9
    right = draw.random((len(good), 4)) < np.where(good[:, None], g, b)
    votes = np.where(right == good[:, None], 1, -1) * (draw.random((len(good), 4)) < cast)
    patterns, weight = np.unique(votes, axis=0, return_counts=True)
    model = weak_labels.fit(patterns, weight)
    assert abs(model.prior - 0.8) < 0.03
    np.testing.assert_allclose(model.good_accuracy, g, atol=0.02)
    np.testing.assert_allclose(model.bad_accuracy, b, atol=0.06)
    assert model == weak_labels.fit(patterns[::-1], weight[::-1])


def test_equal_rows_are_dealt_apart(spark, monkeypatch):
    """Many repeated rows fill several groups, and are scored like others."""
    monkeypatch.setattr(di, "GROUP_BYTES", 4_000)
    monkeypatch.setattr(di, "RANGE_BYTES", 8_000)
    doc_id = next(i for i in range(20) if not brute.held_out(i))
    docs = spark.range(400).selectExpr(f"{doc_id}L AS doc_id", "'the same words again and again in every row' AS text").repartition(3)
    groups = di._prepared(docs, "doc_id", "text", 10).groupBy("pid").count().collect()
    assert len(groups) == 10 and max(r["count"] for r in groups) < 100
    found = di.score(docs).collect()
    assert len(found) == 400 and len({(r.score, r.base_score, r.n_tokens, r.train_tokens) for r in found}) == 1
    assert found[0].train_tokens == 400 * 10 and found[0].n_known == 10
