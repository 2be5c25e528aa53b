"""Descriptive statistics as Spark aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haltwerk.functions.ranks import quantiles, quantiles_wide
from haltwerk.functions.scalars import share


def count_share(df: DataFrame, by: str, pct: str = "pct", digits: int = 1) -> DataFrame:
    """Rows per group and their percentage of all rows."""
    counted = share_of_total(df.groupBy(by).agg(F.count(F.lit(1)).alias("count")))
    return counted.withColumn(pct, F.round(100.0 * F.col("share"), digits)).drop("share")


def null_rates(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows, nulls and null rate per column (and group), in long form, from one pass."""
    present = [c for c in columns if c in df.columns]
    counted = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_rows"), *[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in present]
    )
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("null_count")) for c in present])
    return counted.withColumn("_e", F.explode(entries)).select(
        *by,
        "_e.column",
        "_e.null_count",
        "total_rows",
        share(F.col("_e.null_count"), F.col("total_rows")).alias("null_rate"),
    )


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, null count, mean, std, min, quartiles (nearest) and max per column."""
    unpivoted = df.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
        ).alias("_e")
    ).select("_e.*")
    basic = unpivoted.groupBy("column").agg(
        F.count("value").alias("count"),
        F.count(F.when(F.col("value").isNull(), 1)).alias("null_count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    quarter = quantiles_wide(unpivoted, "value", {"p25": 0.25, "p50": 0.5, "p75": 0.75}, ["column"], "nearest")
    return basic.join(quarter, "column", "left")


def threshold_ladder(df: DataFrame, value: str, thresholds: Sequence[float], below: bool = True) -> DataFrame:
    """Rows and share below (or above) each threshold."""
    v = F.col(value)
    hits = [F.count(F.when(v < t if below else v > t, 1)).alias(f"_t{i}") for i, t in enumerate(thresholds)]
    counted = df.agg(F.count(v).alias("n"), *hits)
    entries = F.array(
        *[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_t{i}").alias("hits")) for i, t in enumerate(thresholds)]
    )
    return counted.withColumn("_e", F.explode(entries)).select(
        "_e.threshold", "_e.hits", share(F.col("_e.hits"), F.col("n")).alias("share")
    )


def bin_index(value: Column, low: Column | float, high: Column | float, bins: int) -> Column:
    """Bin from 0; the last bin includes its upper edge; NULL outside the range."""
    low = low if isinstance(low, Column) else F.lit(float(low))
    high = high if isinstance(high, Column) else F.lit(float(high))
    position = F.floor((value - low) / (high - low) * bins)
    inside = (value >= low) & (value <= high)
    return F.when(inside, F.least(position, F.lit(bins - 1))).cast("long")


def histogram(
    df: DataFrame, value: str, low: float, high: float, bins: int, scale: str = "linear"
) -> DataFrame:
    """Occupied bins of a fixed-width histogram on a linear, log or log1p axis."""
    v = F.col(value).cast("double")
    if scale == "log":
        v, low_edge, high_edge = F.ln(F.when(v > 0, v)), F.ln(F.lit(float(low))), F.ln(F.lit(float(high)))
    elif scale == "log1p":
        v, low_edge, high_edge = F.log1p(v), F.log1p(F.lit(float(low))), F.log1p(F.lit(float(high)))
    else:
        low_edge, high_edge = F.lit(float(low)), F.lit(float(high))
    binned = df.select(bin_index(v, low_edge, high_edge, bins).alias("bin")).filter("bin is not null")
    width = (high_edge - low_edge) / bins
    return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("count")).withColumn("edge", low_edge + F.col("bin") * width)


def clipped_histogram(df: DataFrame, value: str, bins: int, q: float = 0.99) -> DataFrame:
    """Histogram from the minimum up to a quantile of the column."""
    limit = quantiles(df, value, [q]).select("value").scalar()
    kept = df.filter(F.col(value) <= limit)
    low = kept.agg(F.min(value)).scalar().cast("double")
    high = kept.agg(F.max(value)).scalar().cast("double")
    binned = kept.select(bin_index(F.col(value).cast("double"), low, high, bins).alias("bin")).filter("bin is not null")
    return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("count"))


def density_grid(
    df: DataFrame,
    x: str,
    y: str,
    x_range: tuple[float, float],
    y_range: tuple[float, float],
    bins: int,
) -> DataFrame:
    """Occupied cells of a two-dimensional histogram."""
    cells = df.select(
        bin_index(F.col(x).cast("double"), *x_range, bins).alias("x_bin"),
        bin_index(F.col(y).cast("double"), *y_range, bins).alias("y_bin"),
    ).filter("x_bin is not null and y_bin is not null")
    return cells.groupBy("x_bin", "y_bin").agg(F.count(F.lit(1)).alias("count"))


def hex_grid(
    df: DataFrame, x: str, y: str, x_range: tuple[float, float], y_range: tuple[float, float], columns: int = 65
) -> DataFrame:
    """Occupied hexagons of a plane: lattice, column, row, centre, count and its decimal logarithm.

    Centres stand on two lattices, the second one offset by half a cell both
    ways; a point belongs to the nearer centre, which makes the cells hexagons.
    There are ``columns`` cells across and as many rows as keep them regular.
    Points outside the ranges (edges are inside) and missing ones count nowhere.
    """
    rows = int(columns / 3**0.5)
    (x_low, x_high), (y_low, y_high) = x_range, y_range
    u = (F.col(x).cast("double") - x_low) * (columns / (x_high - x_low))
    v = (F.col(y).cast("double") - y_low) * (rows / (y_high - y_low))
    inside = F.col(x).between(x_low, x_high) & F.col(y).between(y_low, y_high)
    points = df.filter(inside).select(u.alias("u"), v.alias("v"))
    # the nearest centre of either lattice; a row is the root of three times as high as a column is wide
    centres = {"i0": F.floor(F.col("u") + 0.5), "j0": F.floor(F.col("v") + 0.5), "i1": F.floor("u"), "j1": F.floor("v")}
    near = points.withColumns(centres)
    first = (F.col("u") - F.col("i0")) ** 2 + 3 * (F.col("v") - F.col("j0")) ** 2
    second = (F.col("u") - F.col("i1") - 0.5) ** 2 + 3 * (F.col("v") - F.col("j1") - 0.5) ** 2
    lattice = F.when(first < second, 0).otherwise(1)
    cells = near.select(
        lattice.alias("lattice"),
        F.when(first < second, F.col("i0")).otherwise(F.col("i1")).cast("long").alias("column"),
        F.when(first < second, F.col("j0")).otherwise(F.col("j1")).cast("long").alias("row"),
    )
    counted = cells.groupBy("lattice", "column", "row").agg(F.count(F.lit(1)).alias("count"))
    half = F.col("lattice") * 0.5
    return counted.withColumns(
        {
            "x": x_low + (F.col("column") + half) * ((x_high - x_low) / columns),
            "y": y_low + (F.col("row") + half) * ((y_high - y_low) / rows),
            "log_count": F.log10("count"),
        }
    )


def binned_mean(df: DataFrame, x: str, y: str, bins: int, trim: tuple[float, float] = (0.01, 0.99)) -> DataFrame:
    """Mean of y per bin of x between two quantiles of x; the upper edge belongs to no bin."""
    limits = quantiles_wide(df, x, {"_lo": trim[0], "_hi": trim[1]})
    low, high = F.col("_lo"), F.col("_hi")
    v = F.col(x).cast("double")
    inside = df.join(F.broadcast(limits), F.lit(True)).filter((v >= low) & (v < high))  # one row of limits
    position = F.floor((v - low) / ((high - low) / bins)).cast("long")
    return inside.groupBy(F.least(position, F.lit(bins - 1)).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean_y"), F.sum(y).alias("sum_y")
    )


def ols(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line of y on x and the correlation; one row."""
    return df.agg(
        F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)).alias("n"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.corr(x, y).alias("r"),
    )


def trimmed(df: DataFrame, columns: Sequence[str], low: float = 0.05, high: float = 0.95, method: str = "nearest", inside: bool = True) -> DataFrame:
    """Rows between two quantiles in every given column, or with ``inside=False`` those outside in some column.

    All limits come from the untrimmed rows, in one run of quantiles.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    limits = quantiles(df.select(F.inline(cells)), "value", [low, high], ["column"], method)
    picks = []
    for c in columns:
        for name, q in (("lo", low), ("hi", high)):
            picks.append(F.max(F.when((F.col("column") == c) & (F.col("q") == q), F.col("value"))).alias(f"_{name}_{c}"))
    kept = df.join(F.broadcast(limits.agg(*picks)), F.lit(True))  # one row
    between = F.lit(True)
    for c in columns:
        between = between & F.col(c).between(F.col(f"_lo_{c}"), F.col(f"_hi_{c}"))
    return kept.filter(between if inside else ~between).select(*df.columns)


def agreement(df: DataFrame, difference: Column, limits: Sequence[float]) -> DataFrame:
    """Share of rows whose difference lies within each limit."""
    d = df.select(F.abs(difference).alias("_d")).filter("_d is not null")
    counted = d.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(F.col("_d") <= k, 1)).alias(f"_k{i}") for i, k in enumerate(limits)])
    entries = F.array(
        *[F.struct(F.lit(float(k)).alias("limit_sec"), F.col(f"_k{i}").alias("hits")) for i, k in enumerate(limits)]
    )
    return counted.withColumn("_e", F.explode(entries)).select(
        "_e.limit_sec", "_e.hits", share(F.col("_e.hits"), F.col("n")).alias("share")
    )


def error_metrics(df: DataFrame, y: str = "target", pred: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    """Rows, MAE and RMSE, over all rows or per group."""
    error = F.col(y) - F.col(pred)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
    )


def relative_improvement(base: Column, better: Column) -> Column:
    """Percentage by which an error falls."""
    return 100.0 * F.try_divide(base - better, base)


def share_of_total(counted: DataFrame, column: str = "count") -> DataFrame:
    """Add the share of the total to a small table of counts."""
    return counted.withColumn("share", F.col(column) / F.sum(column).over(Window.partitionBy()))
