"""Exact ranks and quantiles of a column of any size and any distribution.

``percentile`` keeps every distinct value of a group in one task, and a global
``row_number`` sorts everything in one task.  Here values are counted first, and
each gets a 64-bit key that orders like the value: the bits of the double.  A
histogram over the leading 12 bits of the keys gives buckets; a bucket with more
than ``LIMIT`` distinct values is *full*, and only full buckets are looked at
again, by the next 12 bits, until none is full or no bits are left.  So no window
has more than 4,096 buckets of one parent or ``LIMIT`` values, whatever the
values: timestamps far from zero, one dense range, mixed signs, outliers.
Results are exact; only the work is spread.

The counted values are written once to the shared folder, since the histograms
decide what is read next.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haltwerk.session import temporary_table

LIMIT = 100_000  # distinct values in one window
SHIFTS = (52, 40, 28, 16, 4, 0)  # low bits left out at each step


def order_key(value: Column) -> Column:
    """A whole number that orders like a double: its bits, negated for negative values.

    NaN comes last, as in Spark's order; both zeros are 0.
    """
    size = F.abs(value)
    guess = F.floor(F.log2(size))  # one off at most, near powers of two
    part = size * F.pow(F.lit(2.0), -guess)
    exponent = guess + F.when(part >= 2, 1).when(part < 1, -1).otherwise(0)
    part = F.when(part >= 2, part / 2).when(part < 1, part * 2).otherwise(part)
    normal = (part * float(1 << 52)).cast("long") + (exponent + 1022).cast("long") * (1 << 52)
    tiny = (size * 2.0**537 * 2.0**537).cast("long")
    bits = (
        F.when(size == 0, F.lit(0).cast("long"))
        .when(F.isnan(size), F.lit((2047 << 52) + 1))
        .when(size == float("inf"), F.lit(2047 << 52))
        .when(size < 2.0**-1022, tiny)
        .otherwise(normal)
    )
    return F.when(value < 0, -bits).otherwise(bits)


def value_counts(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Distinct non-null values of a column per group with their number of rows."""
    return (
        df.select(*by, F.col(value).cast("double").alias("value"))
        .filter(F.col("value").isNotNull())
        .groupBy(*by, "value")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


def _matches(left: DataFrame, right: DataFrame, names: Sequence[str]) -> DataFrame:
    """Inner join in which NULL group keys meet each other."""
    renamed = right.select([F.col(c).alias(f"_r_{c}") if c in names else F.col(c) for c in right.columns])
    condition = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in names]
    return left.join(renamed, condition).drop(*[f"_r_{c}" for c in names])


def _running_before(df: DataFrame, by: Sequence[str], order: str, column: str, name: str) -> DataFrame:
    window = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(column).over(window), F.lit(0)))


def _prefix(shift: int) -> Column:
    return F.shiftright("_key", shift)


def _keyed(counts: DataFrame) -> DataFrame:
    return temporary_table(counts.withColumn("_key", order_key(F.col("value"))), "value-counts")


def _buckets(
    keyed: DataFrame, by: Sequence[str], wanted: Callable[[DataFrame], Column] | None = None, limit: int | None = None
) -> list[tuple[int, DataFrame]]:
    """Buckets that are not full, by the number of bits left out of their prefix.

    Per bucket: ``_p`` (its prefix), ``_cnt`` (rows), ``_below`` (rows in lower
    buckets) and ``n`` (rows of the group).  ``wanted`` chooses the buckets worth
    a look; full ones that are not wanted are not refined.
    """
    limit = LIMIT if limit is None else limit
    totals = [F.sum("cnt").alias("_cnt"), F.count(F.lit(1)).alias("_values")]
    level = keyed.groupBy(*by, _prefix(SHIFTS[0]).alias("_p")).agg(*totals)
    level = _running_before(level, by, "_p", "_cnt", "_below").withColumn("n", F.sum("_cnt").over(Window.partitionBy(*by)))
    rows, found = keyed, []
    for shift, finer in zip(SHIFTS, (*SHIFTS[1:], None)):
        if wanted is not None:
            level = level.filter(wanted(level))
        most = level.agg(F.max("_values")).first()[0]
        if finer is None or most is None or most <= limit:
            return [*found, (shift, level.drop("_values"))]
        level = temporary_table(level, "rank-buckets")  # 4,096 rows a full bucket or group at most
        found.append((shift, level.filter(F.col("_values") <= limit).drop("_values")))
        full = level.filter(F.col("_values") > limit).select(*by, "_p", F.col("_below").alias("_base"), "n")
        rows = _matches(rows.drop("_p", "_base", "n").withColumn("_p", _prefix(shift)), full, [*by, "_p"])
        level = rows.groupBy(*by, F.col("_p").alias("_parent"), "_base", "n", _prefix(finer).alias("_p")).agg(*totals)
        level = _running_before(level, [*by, "_parent"], "_p", "_cnt", "_below")
        level = level.withColumn("_below", F.col("_below") + F.col("_base")).drop("_parent", "_base")
    return found


def _ranks_in(keyed: DataFrame, by: Sequence[str], buckets: list[tuple[int, DataFrame]]) -> DataFrame:
    """Values of the buckets with ``cnt``, ``below`` (rows smaller than the value) and ``n``."""
    parts = []
    for shift, level in buckets:
        placed = _matches(keyed.withColumn("_p", _prefix(shift)), level.select(*by, "_p", "_below", "n"), [*by, "_p"])
        inside = _running_before(placed, [*by, "_p"], "_key", "cnt", "_inside")
        parts.append(inside.select(*by, "value", "cnt", (F.col("_below") + F.col("_inside")).alias("below"), "n"))
    return reduce(DataFrame.unionByName, parts)


def ranked_values(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Distinct values with ``cnt``, ``below`` (rows smaller than the value) and ``n`` (all rows)."""
    keyed = _keyed(counts)
    return _ranks_in(keyed, by, _buckets(keyed, by))


def quantiles(
    df: DataFrame, value: str, qs: Sequence[float | tuple[float, str]], by: Sequence[str] = (), method: str = "linear"
) -> DataFrame:
    """Exact quantiles per group, one row per (group, q).  A q may bring a method of its own.

    ``linear`` interpolates between order statistics, ``nearest`` takes the
    order statistic at ``round(q * (n - 1))``, halves up.  Only the buckets that
    hold a wanted rank are looked into.
    """
    return quantiles_of_counts(value_counts(df, value, by), qs, by, method)


def _rank_pair(q: float, n: Column, method: str) -> tuple[Column, Column]:
    at = F.lit(float(q)) * (n - 1).cast("double")
    if method == "nearest":
        rank = F.floor(at + 0.5)
        return rank, rank
    return F.floor(at), F.ceil(at)


def quantiles_of_counts(
    counts: DataFrame, qs: Sequence[float | tuple[float, str]], by: Sequence[str] = (), method: str = "linear"
) -> DataFrame:
    asked = [q if isinstance(q, tuple) else (q, method) for q in qs]
    if not {m for _, m in asked} <= {"linear", "nearest"}:
        raise ValueError("method is 'linear' or 'nearest'")
    keyed = _keyed(counts)

    def wanted(level: DataFrame) -> Column:
        hit = F.lit(False)
        for q, how in asked:
            for rank in _rank_pair(q, level["n"], how):
                hit = hit | ((level["_below"] <= rank) & (rank < level["_below"] + level["_cnt"]))
        return hit

    ranked = _ranks_in(keyed, by, _buckets(keyed, by, wanted))

    def holds(rank: Column) -> Column:
        return (F.col("below") <= rank) & (rank < F.col("below") + F.col("cnt"))

    picks = []
    for i, (q, how) in enumerate(asked):
        low, high = _rank_pair(q, F.col("n"), how)
        picks.append(F.max(F.when(holds(low), F.col("value"))).alias(f"_lo{i}"))
        picks.append(F.max(F.when(holds(high), F.col("value"))).alias(f"_hi{i}"))
    found = ranked.groupBy(*by, "n").agg(*picks) if by else ranked.groupBy("n").agg(*picks)
    entries = []
    for i, (q, how) in enumerate(asked):
        low, high = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        at = F.lit(float(q)) * (F.col("n") - 1).cast("double")
        result = low + (high - low) * (at - F.floor(at)) if how == "linear" else low
        entries.append(F.struct(F.lit(float(q)).alias("q"), result.alias("value")))
    return found.withColumn("_e", F.explode(F.array(*entries))).select(*by, F.col("n"), "_e.q", "_e.value")


def quantiles_wide(
    df: DataFrame,
    value: str,
    qs: dict[str, float],
    by: Sequence[str] = (),
    method: str = "linear",
) -> DataFrame:
    """Quantiles as named columns, one row per group."""
    rows = quantiles(df, value, list(qs.values()), by, method)
    picks = [F.max(F.when(F.col("q") == q, F.col("value"))).alias(name) for name, q in qs.items()]
    return rows.groupBy(*by).agg(*picks) if by else rows.agg(*picks)


def ecdf(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Share of rows at or below each distinct value."""
    ranked = ranked_values(value_counts(df, value, by), by)
    return ranked.select(*by, "value", ((F.col("below") + F.col("cnt")) / F.col("n")).alias("cdf"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation with average ranks for ties; one row.

    Pairs are counted first, so that a frequent value meets its rank once per
    distinct pair and not once per row.
    """
    pairs = temporary_table(
        df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
        .filter("x is not null and y is not null")
        .groupBy("x", "y")
        .agg(F.count(F.lit(1)).alias("w")),
        "value-pairs",
    )

    def average_ranks(column: str) -> DataFrame:
        counts = pairs.groupBy(F.col(column).alias("value")).agg(F.sum("w").alias("cnt"))
        ranked = ranked_values(counts)
        # centred on the mean rank, which keeps the sums small
        centred = F.col("below") + (F.col("cnt") + 1) / 2 - (F.col("n") + 1) / 2
        return ranked.select(F.col("value").alias(column), centred.alias(f"r{column}"))

    joined = pairs.join(average_ranks("x"), "x").join(average_ranks("y"), "y")
    w, rx, ry = F.col("w"), F.col("rx"), F.col("ry")
    sums = joined.agg(
        F.sum(w).alias("n"),
        F.sum(w * rx * ry).alias("xy"),
        F.sum(w * rx * rx).alias("xx"),
        F.sum(w * ry * ry).alias("yy"),
    )
    return sums.select("n", F.try_divide(F.col("xy"), F.sqrt(F.col("xx") * F.col("yy"))).alias("spearman"))
