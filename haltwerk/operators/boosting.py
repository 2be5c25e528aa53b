"""Boosted regression trees grown stage by stage over a table of binned features.

Several models that share target and rows (feature sets, variants of a column)
grow side by side: one Spark job per tree level sums residuals by model, node,
feature and bin for all of them.  Rows are binned once and written as blocks of
arrays, with a prediction per model; after each round its trees are added to the
predictions, and the blocks are cached, so that a tree meets a row once in the
levels below and once when it is done.  Every ``store_every`` rounds the blocks
written last get the trees since then and are written again, so that a lost
executor costs the jobs of a few rounds and no plan grows.  What reaches the
driver is one histogram per task and level: its size depends on the bins, not on
the rows, and a level has at most ``waves`` tasks for each core.

Categories become numbers, their mean target on the training rows, so that a
feature of any number of categories needs 255 bins and no more.  Training ends
when ``patience`` rounds have brought no lower error on the validation rows;
nothing is fitted twice, and the trees after the best round are dropped.

Model tables are written as Parquet, and read back for scoring and ranking.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from haltwerk.session import checkpoint_folder, delete_folder


@dataclass(frozen=True)
class Settings:
    """How to train.

    Training reads all rows, unless ``fit_rows`` bounds them (training and
    validation rows together, drawn evenly).  ``row_share`` is the share of
    training rows each tree sees, ``min_leaf`` the least of these in a leaf,
    ``prior`` the rows by which a category's mean is drawn to the overall mean,
    ``task_rows`` the rows of one file of blocks.
    """

    rounds: int = 500
    step: float = 0.05
    depth: int = 6
    max_bins: int = 255
    min_leaf: int = 50
    row_share: float = 0.8
    patience: int = 50
    fit_rows: int | None = None
    prior: float = 10.0
    store_every: int = 20
    task_rows: int = 100_000
    waves: int = 4
    seed: int = 42


@dataclass
class Tree:
    """A binary tree in heap order: node k has the children 2 k + 1 and 2 k + 2."""

    feature: np.ndarray  # column of the binned table, -1 for a leaf
    bin: np.ndarray  # the left child takes this bin and lower ones
    value: np.ndarray
    gain: np.ndarray

    @staticmethod
    def empty(depth: int) -> Tree:
        inner, nodes = (1 << depth) - 1, (2 << depth) - 1
        return Tree(np.full(inner, -1, np.int32), np.zeros(inner, np.int32), np.zeros(nodes), np.zeros(inner))

    def nodes(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """Node of each column of ``bins`` (features by rows) after some levels; leaves keep their rows."""
        n = bins.shape[1]
        node, every, flat = np.zeros(n, np.intp), np.arange(n), bins.reshape(-1)
        inner, count = len(self.feature), len(self.value)
        split = np.append(self.feature >= 0, np.zeros(count - inner, bool))
        start = np.where(split, np.append(self.feature, np.zeros(count - inner)), 0).astype(np.intp) * n
        most = np.append(self.bin, np.zeros(count - inner, self.bin.dtype)).astype(np.int32)
        own = np.arange(count)
        # the children of each node stand side by side; a leaf is its own child
        child = np.where(split, [2 * own + 1, 2 * own + 2], own).T.reshape(-1)
        for _ in range(levels):
            right = flat.take(start.take(node) + every) > most.take(node)
            node = child.take(2 * node + right)
        return node


@dataclass
class _Growing:
    columns: list[int]  # of the binned table
    base: float
    trees: list[Tree] = field(default_factory=list)
    best: float = float("inf")
    best_round: int = 0
    done: bool = False


def _category(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def category_means(train: DataFrame, columns: Sequence[str], target: str, prior: float) -> DataFrame:
    """Mean target of each value of each category column: feature, category, mean; drawn to the overall mean."""
    entries = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), _category(c).alias("category")) for c in columns]))
    overall = train.agg(F.avg(target)).scalar()
    summed = train.select(entries.alias("e"), F.col(target).cast("double").alias("y")).groupBy("e.feature", "e.category").agg(F.sum("y").alias("s"), F.count("y").alias("n"))
    return summed.select("feature", "category", ((F.col("s") + overall * prior) / (F.col("n") + prior)).alias("mean"))


def with_means(rows: DataFrame, means: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Category columns replaced by their means; categories without one become NULL."""
    for c in columns:
        own = means.where(F.col("feature") == c).select(F.col("category").alias("_category"), F.col("mean").alias("_mean"))
        rows = rows.withColumn("_key", _category(c)).join(own, F.col("_key") == F.col("_category"), "left").withColumn(c, F.col("_mean")).drop("_key", "_category", "_mean")
    return rows


def bin_edges(train: DataFrame, columns: Sequence[str], max_bins: int) -> list[np.ndarray]:
    """Upper edges of the bins of each column: quantiles of its training values, each value once."""
    parts = max_bins - 1  # one bin is for missing values
    asked = [k / parts for k in range(1, parts)]
    found = train.approxQuantile(list(columns), asked, 1 / (4 * parts))
    return [np.unique(np.array(q, float)) for q in found]


def _number(c: str) -> Column:
    return F.coalesce(F.col(c).cast("double"), F.lit(float("nan")))


def _binned(column: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Bin 0 for missing values, then one per edge and one above all edges."""
    return np.where(np.isnan(column), 0, 1 + np.searchsorted(edges, column, "left"))


_BLOCK = "bins binary, y binary, valid binary, draw binary, p binary"
_NAMES = [field.split()[0] for field in _BLOCK.split(", ")]


class _Block(NamedTuple):
    """Some thousand rows as arrays."""

    bins: np.ndarray  # features by rows
    y: np.ndarray
    valid: np.ndarray
    draw: np.ndarray
    p: np.ndarray  # models by rows


def _bin_type(sizes: np.ndarray) -> np.dtype:
    return np.min_scalar_type(max(sizes, default=1) - 1)


def _write_blocks(rows: DataFrame, columns: Sequence[str], edges: list[np.ndarray], sizes: np.ndarray, bases: list[float], tasks: int, path: str) -> None:
    kind = _bin_type(sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            bins = [_binned(batch.column(k).to_numpy(zero_copy_only=False), e).astype(kind) for k, e in enumerate(edges)]
            y, valid, draw = (batch.column(len(edges) + i).to_numpy(zero_copy_only=False) for i in range(3))
            arrays = [np.array(bins, kind), y, valid, draw, np.repeat(np.array(bases, float), n)]
            yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in arrays], names=_NAMES)

    numbers = rows.select(*[_number(c).alias(f"f{k}") for k, c in enumerate(columns)], "y", "valid", "draw")
    numbers.repartition(tasks).mapInArrow(run, _BLOCK).write.parquet(path)


def _blocks(batch: pa.RecordBatch, sizes: np.ndarray, n_models: int) -> Iterator[_Block]:
    kinds = (_bin_type(sizes), np.float64, np.bool_, np.int64, np.float64)
    for i in range(batch.num_rows):
        bins, y, valid, draw, p = (np.frombuffer(batch.column(k)[i].as_buffer(), kind) for k, kind in enumerate(kinds))
        yield _Block(bins.reshape(len(sizes), len(y)), y, valid, draw, p.reshape(n_models, len(y)))


def _chosen(draw: np.ndarray, seed: int, share: float) -> np.ndarray:
    """The rows a tree sees: the same ones in all jobs of its round."""
    h = draw.astype(np.uint64) ^ np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (h >> np.uint64(11)).astype(float) / (1 << 53) < share


def _sums(level: int, trees: dict[int, Tree], columns: dict[int, list[int]], sizes: np.ndarray, n_models: int, seed: int, share: float):  # noqa: ANN202
    """A job's task: histograms of residuals and counts of each model's left children, and at the root the errors so far."""
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    width, nodes = int(offsets[-1]), max(1, 1 << (level - 1)) if level else 1
    first = (1 << level) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {m: np.zeros((2, nodes, width)) for m in trees}
        errors = {m: np.zeros(2) for m in trees}
        for block in (block for batch in batches for block in _blocks(batch, sizes, n_models)):
            seen = np.flatnonzero(~block.valid & _chosen(block.draw, seed, share))
            bins = block.bins.take(seen, 1)
            for m, tree in trees.items():
                r = block.y - block.p[m]
                if level == 0:
                    errors[m] += (r[block.valid] ** 2).sum(), block.valid.sum()
                    use, at = seen, np.zeros(len(seen), np.intp)
                    own = bins
                else:
                    node = tree.nodes(bins, level) - first
                    left = np.flatnonzero((node >= 0) & (node % 2 == 0))
                    use, at = seen[left], node[left] // 2
                    own = bins.take(left, 1)
                r = r[use]
                for f in columns[m]:
                    size = int(sizes[f])
                    cell = at * size + own[f]
                    part = total[m][:, :, offsets[f] : offsets[f + 1]]
                    part[0] += np.bincount(cell, r, minlength=nodes * size).reshape(nodes, size)
                    part[1] += np.bincount(cell, minlength=nodes * size).reshape(nodes, size)
        models = list(trees)
        yield pa.RecordBatch.from_arrays(
            [pa.array(models, pa.int32()), pa.array([total[m].tobytes() for m in models], pa.binary()), pa.array([errors[m].tolist() for m in models], pa.list_(pa.float64()))],
            names=["model", "sums", "errors"],
        )

    return run


def _best_splits(hist: np.ndarray, columns: list[int], sizes: np.ndarray, min_leaf: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per node of a level: feature (-1 without a split that gains), bin, gain.  ``hist``: 2 by nodes by bins of all features."""
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    nodes = hist.shape[1]
    best, feature, at = np.full(nodes, 1e-9), np.full(nodes, -1, np.int32), np.zeros(nodes, np.int32)
    for f in columns:
        part = hist[:, :, offsets[f] : offsets[f + 1]]
        left = np.cumsum(part, 2)
        whole = left[:, :, -1:]
        right = whole - left
        ok = (left[1] >= min_leaf) & (right[1] >= min_leaf)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = left[0] ** 2 / left[1] + right[0] ** 2 / right[1] - whole[0] ** 2 / whole[1]
        gain = np.where(ok, gain, -np.inf)
        k = gain.argmax(1)
        g = gain[np.arange(nodes), k]
        better = g > best
        best, feature, at = np.where(better, g, best), np.where(better, f, feature), np.where(better, k, at)
    return feature.astype(np.int32), at.astype(np.int32), np.where(feature >= 0, best, 0.0)


def _split_level(tree: Tree, level: int, hist: np.ndarray, columns: list[int], sizes: np.ndarray, s: Settings) -> None:
    """Choose the splits of a level, and the values of the nodes below it."""
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    first = (1 << level) - 1
    feature, at, gain = _best_splits(hist, columns, sizes, s.min_leaf)
    for k in range(hist.shape[1]):
        node, f = first + k, int(feature[k])
        if f < 0:
            continue
        tree.feature[node], tree.bin[node], tree.gain[node] = f, at[k], gain[k]
        part = hist[:, k, offsets[f] : offsets[f + 1]]
        left, whole = part[:, : at[k] + 1].sum(1), part.sum(1)
        for child, (total, n) in ((2 * node + 1, left), (2 * node + 2, whole - left)):
            tree.value[child] = s.step * total / max(n, 1)


def fit(
    rows: DataFrame,
    models: Mapping[str, Sequence[str]],
    path: str,
    target: str = "target",
    valid: str = "valid",
    categories: Sequence[str] = (),
    settings: Settings = Settings(),
) -> str:
    """Train a model per entry of ``models`` (name to its feature columns) and write them below ``path``.

    ``rows`` holds training rows and, where ``valid`` is true, validation rows;
    without any of these all rounds are run.  Rows without a target are left
    out.  Missing numbers and categories unseen in training have a bin of their
    own.  Without training rows the models predict 0.
    """
    spark, s = rows.sparkSession, settings
    place = f"{checkpoint_folder(spark)}/boosting-{uuid.uuid4().hex}"
    columns = sorted({c for cs in models.values() for c in cs})
    used = [c for c in columns if c in categories]
    rows = rows.where(F.col(target).isNotNull()).select(*columns, F.col(target).cast("double").alias("y"), F.coalesce(F.col(valid), F.lit(False)).alias("valid"))
    sums = {r["valid"]: r for r in rows.groupBy("valid").agg(F.count("y").alias("n"), F.avg("y").alias("mean")).collect()}
    n_rows = sum(r["n"] for r in sums.values())
    base = sums[False]["mean"] if False in sums else 0.0
    means = category_means(rows.where("NOT valid"), used, "y", s.prior) if used else spark.createDataFrame([], "feature string, category string, mean double")
    means.write.parquet(f"{path}/means")
    means = spark.read.parquet(f"{path}/means")
    share = 1.0 if s.fit_rows is None else min(1.0, s.fit_rows / max(n_rows, 1))
    drawn = with_means(rows if share == 1.0 else rows.where(F.rand(s.seed) < share), means, used).withColumn("draw", F.monotonically_increasing_id())
    drawn.write.parquet(f"{place}/rows")
    drawn = spark.read.parquet(f"{place}/rows")
    edges = bin_edges(drawn.where("NOT valid"), columns, s.max_bins)
    sizes = np.array([len(e) + 2 for e in edges])
    growing = [_Growing([columns.index(c) for c in cs], base) for cs in models.values()]
    tasks = max(spark.sparkContext.defaultParallelism if n_rows > 20_000 else 1, -(-int(n_rows * share) // s.task_rows))
    _write_blocks(drawn, columns, edges, sizes, [base] * len(growing), tasks, f"{place}/stage-0")
    most = s.waves * spark.sparkContext.defaultParallelism
    stored, stage, stored_at = spark.read.parquet(f"{place}/stage-0").coalesce(most), 0, 0
    state = stored
    cached: list[DataFrame] = []
    kinds = "model int, sums binary, errors array<double>"
    for round_ in range(s.rounds + 1):
        active = [m for m, g in enumerate(growing) if not g.done]
        if not active or (round_ == s.rounds and True not in sums):
            break
        trees = {m: Tree.empty(s.depth) for m in active}
        parents: dict[int, np.ndarray] = {}
        for level in range(s.depth):
            run = _sums(level, trees, {m: growing[m].columns for m in trees}, sizes, len(growing), s.seed + round_, s.row_share)
            found: dict[int, np.ndarray] = {}
            errors = {m: np.zeros(2) for m in trees}
            for row in state.mapInArrow(run, kinds).toArrow().to_pylist():
                m, part = row["model"], np.frombuffer(row["sums"])
                found[m] = found[m] + part if m in found else part
                errors[m] += row["errors"]
            if level == 0:
                while len(cached) > 1:  # the job has filled the last one
                    cached.pop(0).unpersist()
                for m in list(trees):
                    g = growing[m]
                    if errors[m][1]:
                        error = errors[m][0] / errors[m][1]
                        if error < g.best:
                            g.best, g.best_round = error, round_
                        g.done = round_ - g.best_round >= s.patience
                    if g.done or round_ == s.rounds:
                        del trees[m]
            for m, tree in trees.items():
                hist = found.get(m, np.zeros(0)).reshape(2, -1, int(sizes.sum())) if m in found else np.zeros((2, max(1, (1 << level) // 2), int(sizes.sum())))
                if level:
                    both = np.empty((2, 1 << level, hist.shape[2]))
                    both[:, 0::2], both[:, 1::2] = hist, parents[m] - hist
                    first = (1 << (level - 1)) - 1
                    unsplit = tree.feature[first : first + hist.shape[1]] < 0
                    both[:, np.repeat(unsplit, 2)] = 0
                    hist = both
                parents[m] = hist
                _split_level(tree, level, hist, growing[m].columns, sizes, s)
            if not trees:
                break
        for m, tree in trees.items():
            growing[m].trees.append(tree)
        if trees:
            if (round_ + 1) % s.store_every:
                state = _grown(state, {m: [tree] for m, tree in trees.items()}, sizes, len(growing), s.depth)
                cached.append(state.persist())
            else:
                pending = {m: growing[m].trees[stored_at:] for m in trees}
                _grown(stored, pending, sizes, len(growing), s.depth).write.parquet(f"{place}/stage-{stage + 1}")
                _release(cached)
                delete_folder(spark, f"{place}/stage-{stage}")
                stage, stored_at = stage + 1, round_ + 1
                state = stored = spark.read.parquet(f"{place}/stage-{stage}").coalesce(most)
    _release(cached)
    kept = [g.trees[: g.best_round] if True in sums else g.trees for g in growing]
    _write_models(spark, path, list(models), columns, edges, base, kept)
    delete_folder(spark, place)
    return path


def _grown(state: DataFrame, pending: dict[int, list[Tree]], sizes: np.ndarray, n_models: int, depth: int) -> DataFrame:
    """The blocks with predictions that hold the pending trees too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grown = []
            for block in _blocks(batch, sizes, n_models):
                p = block.p.copy()
                for m, trees in pending.items():
                    p[m] += sum(t.value.take(t.nodes(block.bins, depth)) for t in trees)
                grown.append(p.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(grown, pa.binary())], names=_NAMES)

    return state.mapInArrow(run, _BLOCK)


def _release(cached: list[DataFrame]) -> None:
    while cached:
        cached.pop().unpersist()


def _write_models(spark: SparkSession, path: str, names: list[str], columns: list[str], edges: list[np.ndarray], base: float, kept: list[list[Tree]]) -> None:
    rows = []
    for name, trees in zip(names, kept, strict=True):
        rows.append((name, -1, 0, None, None, float(base), 0.0))
        for i, t in enumerate(trees):
            for node in np.flatnonzero(t.value != 0).tolist():
                rows.append((name, i, node, None, None, float(t.value[node]), 0.0))
            for node in np.flatnonzero(t.feature >= 0).tolist():
                f, b = int(t.feature[node]), int(t.bin[node])
                # left: missing values, and numbers up to the edge; bin 0 alone is minus infinity
                top = float("-inf") if b == 0 else float(edges[f][b - 1]) if b <= len(edges[f]) else float("inf")
                rows.append((name, i, node, columns[f], top, None, float(t.gain[node])))
    spark.createDataFrame(rows, "model string, tree int, node int, feature string, threshold double, value double, gain double").coalesce(1).write.parquet(f"{path}/nodes")


def importances(spark: SparkSession, path: str, model: str, features: Sequence[str]) -> DataFrame:
    """Share of the gain of all splits by feature, read from the stored model: feature, importance, rank."""
    nodes = spark.read.parquet(f"{path}/nodes").where((F.col("model") == model) & F.col("feature").isNotNull())
    gains = nodes.groupBy("feature").agg(F.sum("gain").alias("gain"))
    named = spark.createDataFrame([(f,) for f in features], "feature string").join(F.broadcast(gains), "feature", "left")
    total = F.sum(F.coalesce("gain", F.lit(0.0))).over(Window.partitionBy())
    share = F.coalesce(F.try_divide(F.coalesce("gain", F.lit(0.0)), total), F.lit(0.0))
    return named.select("feature", share.alias("importance")).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("importance"), "feature")))


def predict(rows: DataFrame, path: str, models: Mapping[str, str], categories: Sequence[str] = ()) -> DataFrame:
    """The rows with one prediction column per stored model (name to column); all other columns stay.

    Trees are at most rounds by nodes per model, whatever the rows, and go to
    the tasks with the function.
    """
    spark = rows.sparkSession
    means = spark.read.parquet(f"{path}/means")
    nodes = spark.read.parquet(f"{path}/nodes").where(F.col("model").isin(list(models))).toArrow().to_pylist()
    columns = sorted({r["feature"] for r in nodes if r["feature"]})
    used = [c for c in columns if c in categories]
    count = max((r["node"] for r in nodes), default=0) + 1
    depth = max(1, count.bit_length() - 1)
    forests: dict[str, dict[int, tuple]] = {m: {} for m in models}
    for r in nodes:
        size = (2 << depth) - 1
        tree = forests[r["model"]].setdefault(r["tree"], (np.full(size, -1), np.full(size, np.inf), np.zeros(size)))
        if r["feature"] is not None:
            tree[0][r["node"]], tree[1][r["node"]] = columns.index(r["feature"]), r["threshold"]
        else:
            tree[2][r["node"]] = r["value"]
    carried = rows.columns
    keyed = rows.select(*carried, *[F.col(c).alias(f"_x{k}") for k, c in enumerate(columns)])
    names = {f"_x{columns.index(c)}": c for c in used}
    renamed = means.replace({c: x for x, c in names.items()}, subset=["feature"]) if names else means
    ready = with_means(keyed, renamed, list(names))
    ready = ready.select(*carried, *[_number(f"_x{k}").alias(f"_x{k}") for k in range(len(columns))])
    schema = ready.select(*carried).limit(0).toArrow().schema
    for column in models.values():
        schema = schema.append(pa.field(column, pa.float64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, every = batch.num_rows, np.arange(batch.num_rows)
            x = np.stack([batch.column(len(carried) + k).to_numpy() for k in range(len(columns))]) if columns else np.zeros((1, n))
            x = np.where(np.isnan(x), -np.inf, x)
            out = []
            for m in models:
                p = np.zeros(n)
                for feature, threshold, value in forests[m].values():
                    node = np.zeros(n, np.int64)
                    for _ in range(depth):
                        f = feature[node]
                        node = np.where(f >= 0, 2 * node + 1 + (x[np.maximum(f, 0), every] > threshold[node]), node)
                    p += value[node]
                out.append(pa.array(p))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carried)], *out], schema=schema)

    kinds = reduce(lambda kind, c: kind.add(c, "double"), models.values(), ready.select(*carried).schema)
    return ready.mapInArrow(run, kinds)
