"""Computed against fixed dwell time: split, variants, model and scores."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from haltwerk.functions.scalars import clip
from haltwerk.functions.stats import error_metrics, relative_improvement
from haltwerk.operators import boosting
from haltwerk.operators.boosting import Settings
from haltwerk.operators.features import CATEGORICAL, FEATURE_SETS, TRAVEL_CLIP


def split_days(features: DataFrame, min_rows: int = 10_000, n_valid: int = 2) -> DataFrame:
    """Rows per service day and the split it belongs to.

    The last full day is the test day, the ``n_valid`` full days before it are
    for validation; all other days train, short ones included.  The table has
    one row per day, so one window over it is small.
    """
    days = features.groupBy("service_date").agg(F.count(F.lit(1)).alias("n"))
    full = F.col("n") >= min_rows
    rank = F.count(F.when(full, 1)).over(Window.orderBy(F.col("service_date").desc()))
    split = (
        F.when(full & (rank == 1), "test").when(full & (rank <= 1 + n_valid), "valid").otherwise("train")
    )
    return days.withColumn("split", split)


def temporal_split(features: DataFrame, min_rows: int = 10_000, n_valid: int = 2) -> DataFrame:
    """Feature rows with their split."""
    days = split_days(features, min_rows, n_valid).select("service_date", "split")
    return features.join(days, "service_date")


def fixed_dwell(split: DataFrame, fallback: str = "split") -> DataFrame:
    """Replace the dwell time by the line's training mean.

    Lines unseen in training get the row-weighted mean of the joined means of
    their split, or with ``fallback="train"`` the training mean.
    """
    train = split.filter("split = 'train'")
    per_line = train.groupBy("linie").agg(F.avg("dwell_time").alias("_mean"))
    joined = split.join(per_line, "linie", "left")
    if fallback == "train":
        return joined.withColumn("dwell_time", F.coalesce("_mean", train.agg(F.avg("dwell_time")).scalar())).drop("_mean")
    if fallback != "split":
        raise ValueError("fallback is 'split' or 'train'")
    # one row per split; a window over the split would send all of it to one task
    means = joined.groupBy("split").agg(F.avg("_mean").alias("_fallback"))
    return (
        joined.join(F.broadcast(means), "split")
        .withColumn("dwell_time", F.coalesce("_mean", "_fallback"))
        .drop("_mean", "_fallback")
    )


def split_counts(split: DataFrame) -> DataFrame:
    """Rows and days per split."""
    return split.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("service_date").alias("days"),
        F.min("service_date").alias("first_day"),
        F.max("service_date").alias("last_day"),
    )


def feature_set(split: DataFrame, name: str) -> DataFrame:
    """Columns of one feature configuration plus target and split."""
    return split.select(*FEATURE_SETS[name], "target", "split")


VARIANTS = ("computed", "fixed")


def both_variants(split: DataFrame) -> DataFrame:
    """Each row once, with the computed and the fixed dwell time beside each other."""
    fixed = fixed_dwell(split.withColumn("dwell_computed", F.col("dwell_time")))
    return fixed.withColumnRenamed("dwell_time", "dwell_fixed")


def model_columns(sets: Iterable[str] = tuple(FEATURE_SETS)) -> dict[str, list[str]]:
    """Name and feature columns of the model of every set and variant."""
    return {f"{s} {v}": [f"dwell_{v}" if c == "dwell_time" else c for c in FEATURE_SETS[s]] for s in sets for v in VARIANTS}


def fit_models(split: DataFrame, path: str, sets: Iterable[str] = tuple(FEATURE_SETS), settings: Settings = Settings()) -> str:
    """Train the models of all sets and variants on the training days and write them below ``path``."""
    rows = both_variants(split.filter(F.col("split").isin("train", "valid"))).withColumn("valid", F.col("split") == "valid")
    return boosting.fit(rows, model_columns(sets), path, categories=CATEGORICAL, settings=settings)


def predictions(split: DataFrame, path: str, sets: Iterable[str] = tuple(FEATURE_SETS), lo: float = TRAVEL_CLIP[0], hi: float = TRAVEL_CLIP[1]) -> DataFrame:
    """Test rows with the prediction of each stored model, clipped to the target's bounds; one row per model."""
    names = {name: f"_p{k}" for k, name in enumerate(model_columns(sets))}
    rows = boosting.predict(both_variants(split).filter("split = 'test'"), path, names, CATEGORICAL)
    scored = [
        F.struct(F.lit(s).alias("feature_set"), F.lit(v).alias("variant"), clip(names[f"{s} {v}"], lo, hi).alias("pred")) for s in sets for v in VARIANTS
    ]
    return rows.withColumn("_s", F.explode(F.array(*scored))).select(
        "_s.feature_set",
        "_s.variant",
        F.col("is_peak_hour").cast("bigint").alias("is_peak_hour"),
        F.col("stop_status").cast("bigint").alias("stop_status"),
        "target",
        "_s.pred",
    )


def feature_rank(spark: SparkSession, path: str, name: str = "Full", variant: str = "computed") -> DataFrame:
    """Features of a stored model by their share of the gain; one row per feature."""
    columns = model_columns([name])[f"{name} {variant}"]
    ranked = boosting.importances(spark, path, f"{name} {variant}", columns)
    return ranked.withColumn("feature", F.when(F.col("feature") == f"dwell_{variant}", "dwell_time").otherwise(F.col("feature")))


def compare_variants(scored: Mapping[str, DataFrame]) -> DataFrame:
    """MAE and RMSE of the computed and the fixed variant and the improvement in percent."""
    computed = error_metrics(scored["computed"]).select(F.col("mae").alias("mae_computed"), F.col("rmse").alias("rmse_computed"))
    fixed = error_metrics(scored["fixed"])
    both = computed.withColumns(
        {"mae_fixed": fixed.select("mae").scalar(), "rmse_fixed": fixed.select("rmse").scalar()}
    )
    return both.withColumns(
        {
            "mae_improvement_pct": relative_improvement(F.col("mae_fixed"), F.col("mae_computed")),
            "rmse_improvement_pct": relative_improvement(F.col("rmse_fixed"), F.col("rmse_computed")),
        }
    )


def compared_sets(predicted: DataFrame, sets: Iterable[str] = tuple(FEATURE_SETS)) -> DataFrame:
    """Both variants' errors per feature set; one row per set."""
    results = None
    for name in sets:
        rows = predicted.filter(F.col("feature_set") == name)
        row = compare_variants({v: rows.filter(F.col("variant") == v) for v in ("computed", "fixed")}).withColumn("feature_set", F.lit(name))
        results = row if results is None else results.unionByName(row)
    return results


def run_ablation(split: DataFrame, path: str, sets: Iterable[str] = tuple(FEATURE_SETS), settings: Settings = Settings()) -> DataFrame:
    """Fit, store and score both variants per feature set; one row per set."""
    sets = tuple(sets)
    return compared_sets(predictions(split, fit_models(split, path, sets, settings), sets), sets)
