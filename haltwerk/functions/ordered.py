"""Ordered series that survive a hot key.

A plain ``Window.partitionBy(vehicle)`` puts a whole vehicle into one task.  If
one vehicle holds a third of all rows, that task never ends.  Here such a series
is cut into time slices: windows run per (key, slice), and one row per slice
carries what crosses its edge (row count, last and first values, running sums).
Only this edge table is windowed per key, and its size per key is the number of
slices, however many rows a key has.

:func:`spread_hot` cuts hot keys only and leaves all others to the plain
window, so that ordinary data pays for one count per key and nothing else.
Without it every key is cut at a fixed length.  Results are the same for any
cut; it is a tuning knob only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

SLICE = "_slice"
STEPS = 1024  # quantiles asked of a hot key's sketch, at least twice its slices; more for keys of over 500 slices


@dataclass(frozen=True)
class Series:
    """Key, order and slicing of an ordered series.

    ``time`` is a timestamp and ``ties`` makes the order total.
    ``slice_length`` in seconds cuts every key, unless ``hot`` lists the keys to
    cut and their lengths, or ``whole`` says that none needs a cut.
    """

    keys: tuple[str, ...]
    time: str
    ties: tuple[str, ...] = ()
    slice_length: int = 900
    hot: DataFrame | None = field(default=None, compare=False, repr=False)
    crowded: DataFrame | None = field(default=None, compare=False, repr=False)
    whole: bool = field(default=False, compare=False, repr=False)

    @property
    def order(self) -> list[str]:
        return [self.time, *self.ties]

    def keyed_by(self, *keys: str) -> "Series":
        return replace(self, keys=keys, hot=None, crowded=None, whole=False)

    def over(self, time: str, *ties: str) -> "Series":
        """The same keys and cut for rows with another time column.

        Instants that were cut by other ties are not cut: their rows are fewer here.
        """
        return replace(self, time=time, ties=ties, crowded=None if ties != self.ties else self.crowded)


_NO_TIME = -(2**62)  # rows without a time stand first
_TIES = 2**20  # tie slices of one instant


def _micros(time: str) -> Column:
    return F.coalesce(F.unix_micros(time), F.lit(_NO_TIME))


def _bounds(value: str, n: str, rows_per_slice: int) -> Column:
    """Values that cut ``n`` rows into slices of about equal counts; a value that fills several slices stands once for each.

    Slices aim at half the limit, and the sketch behind the bounds is off by a
    quarter of the limit at most, so that no slice goes beyond it but where one
    value alone does.
    """
    slices = f"cast(ceil(2 * {n} / {rows_per_slice}) as int)"
    shares = f"transform(sequence(1, greatest({slices} - 1, 1)), i -> i / {slices})"
    return F.expr(f"transform({shares}, s -> element_at({value}, greatest(1, cast(ceil(s * size({value})) as int))))")


def spread_hot(df: DataFrame, series: Series, rows_per_slice: int = 2_000_000, steps: int = STEPS) -> Series:
    """Cut only keys with more than ``rows_per_slice`` rows, into slices of about equal row counts.

    Bounds are quantiles of a hot key's times, so bursts, gaps and wrong clock
    readings make no slice larger.  Where one instant (or a missing time) fills
    whole slices, its rows are cut further by quantiles of the first tie column.

    ``df`` needs the keys, the time and the first tie column (if there are
    ties).  Quantiles come from mergeable sketches whose size depends on
    ``steps``; the tables of hot keys and hot instants have at most
    2 * (all rows / rows_per_slice) bounds, which bounds the broadcasts.  One job
    counts the keys right away, and without hot keys nothing else is planned;
    pass the series on instead of finding it again.
    """
    names = [f"_h_{k}" for k in series.keys]
    keyed = df.select(*[F.col(k).alias(n) for k, n in zip(series.keys, names)], _micros(series.time).alias("_t"), *series.ties[:1])
    counted = keyed.groupBy(*names).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows_per_slice)
    if counted.isEmpty():  # nothing to cut: plain windows, no edges
        return replace(series, hot=None, crowded=None, whole=True)
    match = [F.col(n).eqNullSafe(F.col(f"_c{n}")) for n in names]
    renamed = counted.select(*[F.col(n).alias(f"_c{n}") for n in names], "_n")
    rows = keyed.join(F.broadcast(renamed), match).drop(*[f"_c{n}" for n in names])
    shares = F.lit([i / steps for i in range(1, steps)])
    marks = rows.groupBy(*names).agg(F.max("_n").alias("_n"), F.percentile_approx("_t", shares, F.lit(4 * steps)).alias("_marks"))
    hot = marks.select(*names, _bounds("_marks", "_n", rows_per_slice).alias("_bounds")).persist()
    if not series.ties:
        return replace(series, hot=hot)
    repeated = hot.select(*names, F.explode("_bounds").alias("_instant")).groupBy(*names, "_instant").count().filter("count > 1").drop("count")
    tie = series.ties[0]
    again = repeated.select(*[F.col(n).alias(f"_c{n}") for n in names], "_instant")
    crowded = rows.join(F.broadcast(again), [*match, F.col("_t") == F.col("_instant")])
    ties = crowded.groupBy(*names, "_instant").agg(
        F.count(F.lit(1)).alias("_n"), F.percentile_approx(tie, shares, F.lit(4 * steps)).alias("_marks")
    )
    ties = ties.select(*names, "_instant", _bounds("_marks", "_n", rows_per_slice).alias("_tie_bounds")).persist()
    return replace(series, hot=hot, crowded=ties)


def _key_names(series: Series) -> list[str]:
    return [f"_k_{key}" for key in series.keys]


def _place(bounds: str, value: str) -> Column:
    """How many of the ascending bounds are not above the value; looks at every 32nd, then at 32."""
    heads = f"32 * size(filter({bounds}, (b, i) -> i % 32 = 31 and b <= {value}))"
    return F.expr(f"cast({heads} + size(filter(slice({bounds}, 1 + {heads}, 32), b -> b <= {value})) as bigint)")


def sliced(df: DataFrame, series: Series) -> DataFrame:
    """Add copies of the keys and the slice number, NULL for keys that are not cut.

    NULL keys are a key of their own: windows group them, and edges are joined
    null-safely.
    """
    columns = {name: F.col(key) for key, name in zip(series.keys, _key_names(series))}
    if series.whole:
        return df.withColumns({**columns, SLICE: F.lit(None).cast("bigint")})
    if series.hot is None:
        number = F.expr(f"unix_micros(`{series.time}`) div {int(series.slice_length) * 1_000_000}")
        columns[SLICE] = F.coalesce(number, F.lit(_NO_TIME))
        return df.withColumns(columns)
    names = [f"_h_{k}" for k in series.keys]
    base = df.withColumn("_t", _micros(series.time))
    joined = base.join(F.broadcast(series.hot), [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(series.keys, names)], "left").drop(*names)
    number = _place("_bounds", "_t") * _TIES
    if series.crowded is not None and series.ties[0] in df.columns:
        match = [*[F.col(k).eqNullSafe(F.col(n)) for k, n in zip(series.keys, names)], F.col("_t") == F.col("_instant")]
        joined = joined.join(F.broadcast(series.crowded), match, "left").drop(*names, "_instant")
        # rows of the slice after its crowded instant come last
        number = number + F.when(F.col("_tie_bounds").isNull(), F.lit(_TIES - 1)).otherwise(_place("_tie_bounds", f"`{series.ties[0]}`"))
    columns[SLICE] = F.when(F.col("_bounds").isNotNull(), number)
    return joined.withColumns(columns).drop("_t", "_bounds", "_tie_bounds")


def with_edges(base: DataFrame, edges: DataFrame, series: Series) -> DataFrame:
    """Left join of an edge table; keys match null-safely, rows of keys that are not cut match nothing."""
    part = slice_columns(series)
    if series.whole:
        return base.withColumns({f.name: F.lit(None).cast(f.dataType) for f in edges.schema.fields if f.name not in part})
    other = edges.withColumnsRenamed({c: f"_e{c}" for c in part})
    match = [F.col(c).eqNullSafe(F.col(f"_e{c}")) for c in _key_names(series)]
    return base.join(other, [*match, F.col(SLICE) == F.col(f"_e{SLICE}")], "left").drop(*[f"_e{c}" for c in part])


def cut_rows(df: DataFrame) -> DataFrame:
    """Rows of series that are cut; only those need an edge table."""
    return df.filter(F.col(SLICE).isNotNull())


def unsliced(df: DataFrame) -> DataFrame:
    """Drop the helper columns of :func:`sliced`."""
    return df.drop(SLICE, *[c for c in df.columns if c.startswith("_k_")])


def _is_sliced(df: DataFrame, series: Series) -> bool:
    return {SLICE, *_key_names(series)} <= set(df.columns)


def slice_columns(series: Series) -> list[str]:
    """Columns that make up one slice of one series."""
    return [*_key_names(series), SLICE]


def within_slice(series: Series, backward: bool = False) -> WindowSpec:
    """Window over the rows of one slice."""
    order = [F.col(c).desc() for c in series.order] if backward else series.order
    return Window.partitionBy(*slice_columns(series)).orderBy(*order)


def across_slices(series: Series) -> tuple[WindowSpec, WindowSpec]:
    """Windows over the edge table: all earlier and all later slices of a key."""
    keys = Window.partitionBy(*_key_names(series))
    earlier = keys.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    later = keys.orderBy(F.col(SLICE).desc()).rowsBetween(Window.unboundedPreceding, -1)
    return earlier, later


def slice_edges(
    df: DataFrame,
    series: Series,
    lag: Mapping[str, str] | None = None,
    lead: Mapping[str, str] | None = None,
    index: bool = False,
) -> DataFrame:
    """Per slice: rows before it, last row before it and first row after it.

    Frames of the same series may share one edge table, also if they use only
    some of its values; Spark then computes it once.
    """
    base = df if _is_sliced(df, series) else sliced(df, series)
    part = slice_columns(series)
    rank = F.struct(*series.order)
    found = []
    if index:
        found.append(F.count(F.lit(1)).alias("_n"))
    if lag:
        found.append(F.max_by(_bundle(lag), rank).alias("_last"))
    if lead:
        found.append(F.min_by(_bundle(lead), rank).alias("_first"))
    per_key = Window.partitionBy(*_key_names(series)).orderBy(SLICE)
    carried: list[str | Column] = [*part]
    if index:
        before = F.sum("_n").over(per_key.rowsBetween(Window.unboundedPreceding, -1))
        carried.append(F.coalesce(before, F.lit(0)).alias("_count_before"))
    if lag:
        carried.append(F.lag("_last").over(per_key).alias("_last"))
    if lead:
        carried.append(F.lead("_first").over(per_key).alias("_first"))
    return cut_rows(base).groupBy(*part).agg(*found).select(*carried)


def neighbours(
    df: DataFrame,
    series: Series,
    lag: Mapping[str, str] | None = None,
    lead: Mapping[str, str] | None = None,
    index: str | None = None,
    keep_slices: bool = False,
    edges: DataFrame | None = None,
) -> DataFrame:
    """Row number from 0 and values of the previous / next row of the series.

    ``lag`` and ``lead`` map a new column to its source column.
    """
    lag, lead = dict(lag or {}), dict(lead or {})
    base = df if _is_sliced(df, series) else sliced(df, series)
    if edges is None:
        edges = slice_edges(base, series, lag, lead, index is not None)

    window = within_slice(series)
    joined = with_edges(base, edges, series)
    columns: dict[str, Column] = {}
    if index:
        columns[index] = (F.coalesce("_count_before", F.lit(0)) + F.row_number().over(window) - 1).cast("long")
    if lag:
        first_row = F.row_number().over(window) == 1
        for name, source in lag.items():
            columns[name] = F.when(first_row, F.col(f"_last.{name}")).otherwise(F.lag(source).over(window))
    if lead:
        last_row = F.lead(F.lit(True)).over(window).isNull()
        for name, source in lead.items():
            columns[name] = F.when(last_row, F.col(f"_first.{name}")).otherwise(F.lead(source).over(window))
    result = joined.withColumns(columns).drop("_count_before", "_last", "_first")
    return result if keep_slices else unsliced(result)


def _bundle(columns: Mapping[str, str]) -> Column:
    return F.struct(*[F.col(source).alias(name) for name, source in columns.items()])


def running(
    df: DataFrame,
    series: Series,
    sums: Mapping[str, Column] | None = None,
    latest: Mapping[str, Column] | None = None,
    upcoming: Mapping[str, Column] | None = None,
    keep_slices: bool = False,
) -> DataFrame:
    """Values that accumulate along the series.

    ``sums``      running total up to and including the row
    ``latest``    last non-null value strictly before the row
    ``upcoming``  first non-null value strictly after the row

    Expressions of ``latest`` and ``upcoming`` must not decrease along the
    series (row numbers, times), so that an edge needs only a minimum and a
    maximum and partial aggregation stays in the hash path.
    """
    sums, latest, upcoming = dict(sums or {}), dict(latest or {}), dict(upcoming or {})
    base = df if _is_sliced(df, series) else sliced(df, series)
    inputs = {f"_x_{name}": expr for name, expr in {**sums, **latest, **upcoming}.items()}
    base = base.withColumns(inputs)
    part = slice_columns(series)

    edge_columns = [F.sum(f"_x_{n}").alias(f"_e_{n}") for n in sums]
    edge_columns += [F.max(f"_x_{n}").alias(f"_e_{n}") for n in latest]
    edge_columns += [F.min(f"_x_{n}").alias(f"_e_{n}") for n in upcoming]
    forward, backward = across_slices(series)
    carried = [*part]
    carried += [F.coalesce(F.sum(f"_e_{n}").over(forward), F.lit(0)).alias(f"_e_{n}") for n in sums]
    carried += [F.max(f"_e_{n}").over(forward).alias(f"_e_{n}") for n in latest]
    carried += [F.min(f"_e_{n}").over(backward).alias(f"_e_{n}") for n in upcoming]
    edges = cut_rows(base).groupBy(*part).agg(*edge_columns).select(*carried)

    ordered = within_slice(series)
    up_to = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    # Reading the slice backwards keeps the frame growing; a frame that ends at
    # UNBOUNDED FOLLOWING is evaluated anew for every row.
    after = within_slice(series, backward=True).rowsBetween(Window.unboundedPreceding, -1)
    columns: dict[str, Column] = {}
    for n in sums:
        columns[n] = F.coalesce(f"_e_{n}", F.lit(0)) + F.coalesce(F.sum(f"_x_{n}").over(up_to), F.lit(0))
    for n in latest:
        columns[n] = F.coalesce(F.max(f"_x_{n}").over(before), F.col(f"_e_{n}"))
    for n in upcoming:
        columns[n] = F.coalesce(F.min(f"_x_{n}").over(after), F.col(f"_e_{n}"))
    names = [*sums, *latest, *upcoming]
    result = with_edges(base, edges, series).withColumns(columns)
    result = result.drop(*[f"_e_{n}" for n in names], *[f"_x_{n}" for n in names])
    return result if keep_slices else unsliced(result)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """First row per key in a given order.

    ``row_number() = 1`` lets Spark drop all but one row per key before the
    shuffle (window group limit), so a hot key costs no more than any other.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).filter("_rn = 1").drop("_rn")
