"""Stage-wise boosted trees: splits, patience, stored models, and the registered model queries."""

import math
import random
import uuid

import pytest

from haltwerk.operators import ablation, boosting
from haltwerk.operators.boosting import Settings
from haltwerk.plans.catalog import QUERIES
from haltwerk.session import checkpoint_folder, delete_at_exit

PLAIN = Settings(step=0.5, depth=1, min_leaf=1, row_share=1.0, rounds=4)


@pytest.fixture
def place(spark):
    return delete_at_exit(spark, f"{checkpoint_folder(spark)}/test-models-{uuid.uuid4().hex}")


def table(spark, rows):
    return spark.createDataFrame(rows, "x double, c string, target double, valid boolean")


def stumps(rows, rounds, step):
    """Boosted stumps on (x, target), every split tried."""
    base = sum(y for _, y in rows) / len(rows)
    predicted = [base] * len(rows)
    for _ in range(rounds):
        left_over = [y - p for (_, y), p in zip(rows, predicted)]
        best = None
        for cut in sorted({x for x, _ in rows})[:-1]:
            a = [r for (x, _), r in zip(rows, left_over) if x <= cut]
            b = [r for (x, _), r in zip(rows, left_over) if x > cut]
            gain = sum(a) ** 2 / len(a) + sum(b) ** 2 / len(b) - sum(left_over) ** 2 / len(rows)
            if best is None or gain > best[0] + 1e-9:
                best = gain, cut, sum(a) / len(a), sum(b) / len(b)
        _, cut, low, high = best
        predicted = [p + step * (low if x <= cut else high) for (x, _), p in zip(rows, predicted)]
    return predicted


def test_stumps_are_those_of_an_exhaustive_search(spark, place):
    draw = random.Random(1)
    rows = [(float(draw.randrange(20)), float(draw.randrange(100))) for _ in range(300)]
    df = table(spark, [(x, "a", y, False) for x, y in rows]).repartition(3)
    boosting.fit(df, {"m": ["x"]}, place, settings=PLAIN)
    found = sorted((r.x, r.target, round(r.p, 9)) for r in boosting.predict(df, place, {"m": "p"}).collect())
    want = sorted((x, y, round(p, 9)) for (x, y), p in zip(rows, stumps(rows, 4, 0.5)))
    assert [f[:2] for f in found] == [w[:2] for w in want]
    assert all(math.isclose(f[2], w[2], abs_tol=1e-6) for f, w in zip(found, want))


@pytest.mark.parametrize("store_every", [1, 3, 100])
def test_stored_predictions_change_nothing(spark, place, store_every):
    draw = random.Random(2)
    rows = [(draw.random(), "abc"[k % 3], (k % 3) * 10 + draw.random(), k % 5 == 0) for k in range(600)]
    settings = Settings(rounds=10, depth=3, min_leaf=5, store_every=store_every, patience=10)
    boosting.fit(table(spark, rows).repartition(2, "x"), {"both": ["x", "c"], "one": ["x"]}, place, categories=["c"], settings=settings)
    scored = boosting.predict(table(spark, rows), place, {"both": "p", "one": "q"}, ["c"])
    got = scored.selectExpr("avg(pow(p - target, 2)) AS p", "avg(pow(q - target, 2)) AS q").first()
    assert got.p < 0.5 * got.q
    nodes = spark.read.parquet(f"{place}/nodes").where("model = 'both'")
    assert nodes.where("feature = 'c'").count() and nodes.agg({"tree": "max"}).first()[0] == 9


def trees_carried(function):
    """Trees among the values a task's function carries."""
    found, waiting = 0, [c.cell_contents for c in function.__closure__ or ()]
    while waiting:
        value = waiting.pop()
        found += isinstance(value, boosting.Tree)
        waiting += value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
    return found


def test_no_job_grows_earlier_trees_again(spark, place, monkeypatch):
    df = spark.range(2000).selectExpr("double(id % 50) AS x", "'a' AS c", "double(id % 50) AS target", "id % 4 = 0 AS valid")
    carried, kind = [], type(df)
    real = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, f, *given, **named: (carried.append(trees_carried(f)), real(self, f, *given, **named))[1])
    boosting.fit(df, {"m": ["x"], "n": ["x"]}, place, settings=Settings(rounds=6, depth=2, min_leaf=5, store_every=100))
    assert spark.read.parquet(f"{place}/nodes").agg({"tree": "max"}).first()[0] == 5
    assert max(carried) == 2  # one tree of each model, whatever the round


def test_training_ends_with_patience_and_keeps_the_best_trees(spark, place):
    rows = [(float(k % 100), "a", float(k % 100), False) for k in range(400)]
    other = [(x, c, 49.5, True) for x, c, _, _ in rows]
    settings = Settings(rounds=60, depth=2, min_leaf=1, row_share=1.0, patience=4)
    boosting.fit(table(spark, rows + other), {"m": ["x"]}, f"{place}/worse", settings=settings)
    assert spark.read.parquet(f"{place}/worse/nodes").where("tree >= 0").count() == 0  # every tree is worse than the mean
    same = [(x, c, y, True) for x, c, y, _ in rows]
    slow = Settings(rounds=12, step=0.004, depth=1, min_leaf=1, row_share=1.0, patience=4)
    boosting.fit(table(spark, rows + same), {"m": ["x"]}, f"{place}/slow", settings=slow)
    assert spark.read.parquet(f"{place}/slow/nodes").agg({"tree": "max"}).first()[0] == 11


def test_missing_values_and_unseen_categories(spark, place):
    rows = [(None if k % 4 == 0 else float(k % 4), None if k % 3 == 0 else f"c{k % 3}", 100.0 if k % 4 == 0 else float(k % 3), False) for k in range(240)]
    rows.append((1.0, "c1", None, False))
    settings = Settings(rounds=30, step=0.5, depth=3, min_leaf=1, row_share=1.0)
    boosting.fit(table(spark, rows), {"m": ["x", "c"]}, place, categories=["c"], settings=settings)
    asked = table(spark, [(None, "c1", 0.0, False), (1.0, None, 0.0, False), (1.0, "new", 0.0, None), (float("nan"), "c2", 0.0, False)])
    found = [r.p for r in boosting.predict(asked, place, {"m": "p"}, ["c"]).orderBy("c").collect()]
    assert len(found) == 4 and all(math.isfinite(p) for p in found)
    by = {(r.x if r.x == r.x else None, r.c): r.p for r in boosting.predict(asked, place, {"m": "p"}, ["c"]).collect()}
    assert abs(by[None, "c1"] - 100) < 2 and abs(by[1.0, None]) < 2
    boosting.fit(table(spark, rows).where("false"), {"m": ["x", "c"]}, f"{place}/none", categories=["c"], settings=settings)
    assert {r.p for r in boosting.predict(asked, f"{place}/none", {"m": "p"}, ["c"]).collect()} == {0.0}


def test_fit_rows_bounds_training_only(spark, place):
    df = spark.range(4000).selectExpr("double(id % 50) AS x", "'a' AS c", "double(id % 50) AS target", "id % 4 = 0 AS valid")
    settings = Settings(rounds=3, depth=2, fit_rows=400, min_leaf=5)
    boosting.fit(df, {"m": ["x"]}, place, settings=settings)
    assert boosting.predict(df, place, {"m": "p"}).where("p IS NOT NULL").count() == 4000


def test_training_reads_all_rows_by_default(spark, place, monkeypatch):
    df = spark.range(2_050_000).selectExpr("double(id % 50) AS x", "'a' AS c", "double(id % 50) AS target", "id % 4 = 0 AS valid")
    read, real = [], boosting._write_blocks
    monkeypatch.setattr(boosting, "_write_blocks", lambda rows, *given: (read.append(rows.count()), real(rows, *given))[1])
    boosting.fit(df, {"m": ["x"]}, place, settings=Settings(rounds=1, depth=1))
    assert read == [2_050_000] and spark.read.parquet(f"{place}/nodes").where("feature = 'x'").count() == 1


def test_histograms_that_reach_the_driver_are_bounded(spark, place, monkeypatch):
    df = spark.range(800).selectExpr("double(id % 50) AS x", "'a' AS c", "double(id % 50) AS target", "id % 4 = 0 AS valid")
    kind, sums = type(df), []
    real = kind.toArrow
    monkeypatch.setattr(kind, "toArrow", lambda self: (sums.append(real(self)), sums[-1])[1])
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 27))  # a file a task
    try:
        boosting.fit(df, {"m": ["x"]}, place, settings=Settings(rounds=3, depth=2, min_leaf=5, task_rows=10, waves=2, store_every=2))
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(sums) == 7 and {len(x) for x in sums} == {2 * spark.sparkContext.defaultParallelism}  # 80 files; two levels a round, and the last errors


def test_registered_models_have_full_settings_and_are_scored(spark, monkeypatch):
    asked, real = [], boosting.fit

    def small(rows, models, path, settings=None, **given):
        asked.append((settings, sorted(models)))
        return real(rows, models, path, settings=Settings(rounds=3, depth=2), **given)

    monkeypatch.setattr(boosting, "fit", small)
    folder = "/root/testdata/sf0.001"
    rows = {r.feature_set: r for r in QUERIES["gbt_ablation"].run(spark, folder).collect()}
    scored = {(r.feature_set, r.variant): r for r in QUERIES["model_error_metrics"].run(spark, folder).collect()}
    assert asked == [(Settings(), sorted(ablation.model_columns()))] and len(rows) == 3 and len(scored) == 6
    assert Settings().rounds == 500 and Settings().depth == 6 and Settings().patience == 50
    assert all(r.mae_computed == scored[s, "computed"].mae and r.rmse_fixed == scored[s, "fixed"].rmse for s, r in rows.items())
    groups = QUERIES["model_error_by_group"].run(spark, folder).collect()
    assert sum(r.n for r in groups) == sum(r.n for r in scored.values())
    ranked = QUERIES["feature_rank"].run(spark, folder).collect()
    assert len(ranked) == 11 and abs(sum(r.importance for r in ranked) - 1) < 1e-4
    for name in ("gbt_ablation_checks", "model_error_checks", "model_group_checks", "feature_rank_checks"):
        assert QUERIES[name].run(spark, folder).count() and QUERIES[name].sql
    assert len(asked) == 1  # all queries read the stored models
