"""Gradient boosting of many label vectors over the same features, all replicates at once.

A row keeps its features as bin numbers and one label per replicate. Each level of a tree is one job
for all replicates: tasks add up histograms keyed by (replicate, node, feature, bin), one shuffle sums
them, and the best split of every node comes back. What reaches the driver is the model itself:
replicates times nodes, whatever the number of rows. Residuals are summed as integers (units of
2**-24 of the label range), so reruns agree whatever the partitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pitpanel.plans.ordered import exact_quantiles
from pitpanel.session import materialize, release

UNIT = 1 << 24
ALL_LEFT = 255  # no bin lies above it
SLICE = 2048  # rows worked on at a time


@dataclass(frozen=True)
class Boost:
    """Settings; ``positive`` fits the log odds of a positive label instead of the label itself."""

    trees: int = 100
    depth: int = 4
    step: float = 0.05
    share: float = 0.8
    bins: int = 32
    least: int = 1
    seed: int = 7
    positive: bool = False
    keep_every: int = 10

    def __post_init__(self):
        if not 2 <= self.bins < ALL_LEFT:
            raise ValueError(f"bins must lie between 2 and {ALL_LEFT - 1}")


def bin_edges(train: DataFrame, cols: list[str], bins: int) -> dict[str, list[float]]:
    """Distinct inner quantiles of each feature: at most ``bins - 1`` numbers per feature."""
    probs = [i / bins for i in range(1, bins)]
    edges = {}
    for c in cols:
        x = train.select(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias("x"))
        edges[c] = sorted({r["quantile"] for r in exact_quantiles(x, "x", probs).collect()} - {None})
    return edges


def binned(edges: dict[str, list[float]]) -> Column:
    """Bin numbers of a row: 0 for NULL and NaN, else 1 and the number of edges below the value."""
    def one(c, cuts):
        x = F.col(c).cast("double")
        below = F.size(F.filter(F.array(*[F.lit(e) for e in cuts]), lambda e: e < x)) if cuts else F.lit(0)
        return F.when(x.isNull() | F.isnan(x), F.lit(0)).otherwise(below + 1).cast("short")
    return F.array(*[one(c, cuts) for c, cuts in edges.items()])


def _machine(s: Boost, reps: int):
    """Steps in numpy for tasks, nested so that they travel with the job."""
    each = np.arange(reps)

    def descend(bins, tree, levels):
        node, row = np.zeros((len(bins), reps), np.int64), np.arange(len(bins))[:, None]
        for level in range(levels):
            at = (1 << level) - 1 + node
            node = 2 * node + (bins[row, tree["feature"][each, at]] > tree["cut"][each, at])
        return node

    def advance(bins, trees, out):
        for tree in trees:
            out = out + tree["leaf"][each, descend(bins, tree, s.depth)]
        return out

    def drawn(row, number):
        """Which replicates a row takes part in for a tree: a hash of row, tree and replicate."""
        key = (np.arange(reps, dtype=np.uint64) + np.uint64(number * reps + 1)) * np.uint64(0x9E3779B97F4A7C15)
        x = row.view(np.uint64)[:, None] ^ (key + np.uint64(s.seed))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return (x >> np.uint64(40)) < np.uint64(round(s.share * (1 << 24)))

    def matrix(column, dtype):
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype)
        return flat.reshape(len(column), -1)

    def slices(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                yield batch.slice(at, SLICE)

    return descend, advance, drawn, matrix, slices


@dataclass
class Forest:
    """The boosted models of all replicates; features are bound by name."""

    edges: dict[str, list[float]]
    settings: Boost
    first: np.ndarray
    low: float
    span: float
    trees: list[dict] = field(default_factory=list)

    def score(self, df: DataFrame, keep: list[str], out: str = "score") -> DataFrame:
        """``rep, keep..., score``: one row per row of ``df`` and replicate."""
        s, reps, first, trees, low, span = self.settings, len(self.first), self.first, self.trees, self.low, self.span
        _, advance, _, matrix, slices = _machine(s, reps)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                f = advance(matrix(b.column(0), np.int64), trees, np.broadcast_to(first, (b.num_rows, reps)))
                f = 1 / (1 + np.exp(-f)) if s.positive else low + f * span
                ends = pa.array(np.arange(b.num_rows + 1) * reps, pa.int32())
                yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.ListArray.from_arrays(ends, pa.array(f.ravel()))],
                                                 [*b.schema.names[1:], "_scores"])
        rows = df.select(binned(self.edges).alias("_bins"), *keep)
        schema = rows.drop("_bins").withColumn("_scores", F.array(F.lit(0.0))).schema
        return rows.mapInArrow(run, schema).select(
            *keep, F.posexplode("_scores").alias("_rep", out)).select(F.col("_rep").cast("bigint").alias("rep"), *keep, out)


def _vectors(reps: int):
    """Lists of (replicate, label) as one vector per row, NULL where a replicate has none."""
    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                row = np.repeat(np.arange(b.num_rows), b.column(2).value_lengths().to_numpy(zero_copy_only=False))
                place = row * reps + b.column(2).flatten().to_numpy(zero_copy_only=False)
                if len(place) and np.bincount(place).max() > 1:
                    raise ValueError("a row has two labels of one replicate")
                y, none = np.zeros(b.num_rows * reps), np.ones(b.num_rows * reps, bool)
                y[place], none[place] = b.column(3).flatten().to_numpy(zero_copy_only=False), False
                ends = pa.array(np.arange(b.num_rows + 1) * reps, pa.int32())
                yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.ListArray.from_arrays(ends, pa.array(y, mask=none))], ["_row", "_bins", "_y"])
    return dense


def _level(rows: DataFrame, s: Boost, reps: int, kept: list[dict], tree: dict, number: int, level: int, k: int):
    """Best split of every (replicate, node) of one level: unit, gain, feature, bin, sums left and whole."""
    descend, advance, drawn, matrix, slices = _machine(s, reps)
    width, units = s.bins + 1, reps << level
    unit_of = np.arange(reps) << level

    def histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, k, units * width))
        for b in slices(batches):
            bins, y = matrix(b.column(1), np.int64), matrix(b.column(2), np.float64)
            f = advance(bins, kept, matrix(b.column(3), np.float64))
            some = ~np.isnan(y) & drawn(b.column(0).to_numpy(), number)
            if s.positive:
                p = 1 / (1 + np.exp(-f))
                g, h = (y > 0) - p, np.rint(p * (1 - p) * UNIT)
            else:
                g, h = y - f, np.ones(y.shape)
            g, h = np.where(some, np.rint(g * UNIT), 0.0), np.where(some, h, 0.0)
            unit = (unit_of + descend(bins, tree, level)) * width
            for j in range(k):
                at = (unit + bins[:, j, None]).ravel()
                for i, v in enumerate((g, h)):
                    sums[i, j] += np.bincount(at, v.ravel(), units * width)
        for j in range(k):
            at = np.flatnonzero(sums[1, j])
            yield pa.RecordBatch.from_arrays(
                [pa.array(at // width), pa.array(np.full(len(at), j)), pa.array(at % width),
                 pa.array(sums[0, j, at].astype(np.int64)), pa.array(sums[1, j, at].astype(np.int64))], ["unit", "feature", "bin", "g", "h"])

    cells = rows.mapInArrow(histograms, "unit bigint, feature bigint, bin bigint, g bigint, h bigint")
    # dealt by unit once: sums, running sums and the best split all stay in their partition
    cells = cells.repartition("unit").groupBy("unit", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    upto = W.partitionBy("unit", "feature").orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy("unit", "feature")
    x = cells.select("unit", "feature", "bin", F.sum("g").over(upto).alias("gl"), F.sum("h").over(upto).alias("hl"),
                     F.sum("g").over(whole).alias("ga"), F.sum("h").over(whole).alias("ha"))

    def part(g, h):
        return g.cast("double") * g.cast("double") / h.cast("double")
    gl, hl, ga, ha = (F.col(c) for c in ("gl", "hl", "ga", "ha"))
    gain = F.when((hl >= s.least) & (ha - hl >= s.least), part(gl, hl) + part(ga - gl, ha - hl) - part(ga, ha))
    best = F.max(F.struct(F.coalesce(gain, F.lit(-1.0)).alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"),
                          "gl", "hl", "ga", "ha")).alias("best")
    return x.groupBy("unit").agg(best).select("unit", "best.*").collect()


def fit_replicates(train: DataFrame, cols: list[str], labels: DataFrame, key: list[str], y: str, reps: int,
                   s: Boost = Boost()) -> Forest:
    """Boost every replicate's labels on the features of ``train``.

    ``labels`` has ``rep`` (from 0), ``key`` and ``y``; ``key`` names one row of ``train``. A row without a
    label, or with a NULL or NaN one, takes no part in that replicate; NULL and NaN features have a bin
    of their own. Equal gains go to the first feature, then the lowest bin. Without rows nothing is fitted
    and every score is 0 (0.5 for ``positive``).
    """
    edges = bin_edges(train, cols, s.bins)
    by_rep = labels.where(F.col("rep").between(0, reps - 1) & F.col(y).isNotNull() & ~F.isnan(F.col(y).cast("double"))).groupBy(*key).agg(
        F.collect_list(F.col("rep").cast("int")).alias("_reps"), F.collect_list(F.col(y).cast("double")).alias("_ys"))
    # many labels of few values are a small file, which one task would read: dealt over as many files as shuffles have tasks
    parts = int(train.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    labelled = train.select(*key, binned(edges).alias("_bins")).join(by_rep, key).select(
        F.xxhash64(*key).alias("_row"), "_bins", "_reps", "_ys").repartition(parts, "_row")
    labelled = materialize(labelled.mapInArrow(_vectors(reps), "_row bigint, _bins array<smallint>, _y array<double>"))
    ends = labelled.agg(F.min(F.array_min("_y")).alias("low"), F.max(F.array_max("_y")).alias("high")).first()
    low = ends["low"] or 0.0
    span = ((ends["high"] or 0.0) - low) or 1.0
    value = F.when(F.col("y") > 0, 1.0).otherwise(0.0) if s.positive else (F.col("y") - low) / span
    units = F.sum(F.round(value * UNIT).cast("bigint")).alias("s")
    means = labelled.select(F.posexplode("_y").alias("rep", "y")).where("y IS NOT NULL").groupBy("rep").agg(
        units, F.count("y").alias("n")).collect()
    first = np.zeros(reps)
    for r in means:
        p = r["s"] / UNIT / r["n"]
        first[r["rep"]] = np.log(max(p, 1e-6) / max(1 - p, 1e-6)) if s.positive else p
    forest = Forest(edges, s, first, low, span)
    scaled = labelled if s.positive else labelled.withColumn("_y", F.transform("_y", lambda v: (v - low) / span))
    start = F.array(*[F.lit(float(v)) for v in first])
    rows, kept, k = scaled.withColumn("_f", start), [], len(cols)
    stored = None
    for number in range(s.trees):
        inner = (1 << s.depth) - 1
        tree = {"feature": np.zeros((reps, inner), np.int16), "cut": np.full((reps, inner), ALL_LEFT, np.int16),
                "leaf": np.zeros((reps, inner + 1))}
        scale = s.step * (1 if s.positive else 1 / UNIT)
        for level in range(s.depth):
            for unit, gain, f, b, gl, hl, ga, ha in _level(rows, s, reps, kept, tree, number, level, k):
                rep, node = unit >> level, unit & (1 << level) - 1
                split = gain > 0
                if split:
                    tree["feature"][rep, (1 << level) - 1 + node], tree["cut"][rep, (1 << level) - 1 + node] = -f, -b
                if level == s.depth - 1:
                    tree["leaf"][rep, 2 * node] = scale * (gl / hl if split else ga / ha)
                    tree["leaf"][rep, 2 * node + 1] = scale * ((ga - gl) / (ha - hl)) if split else 0.0
        forest.trees.append(tree)
        kept = [*kept, tree]
        if len(kept) == s.keep_every and number + 1 < s.trees:
            # what the rows have reached is written, so a job never walks more than a few trees
            new = materialize(_advanced(rows, s, reps, kept))
            release(stored)
            rows = stored = new
            kept = []
    release(stored)
    release(labelled)
    return forest


def _advanced(rows: DataFrame, s: Boost, reps: int, trees: list[dict]) -> DataFrame:
    _, advance, _, matrix, slices = _machine(s, reps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            f = advance(matrix(b.column(1), np.int64), trees, matrix(b.column(3), np.float64))
            ends = pa.array(np.arange(b.num_rows + 1) * reps, pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.ListArray.from_arrays(ends, pa.array(f.ravel()))], b.schema.names)
    return rows.mapInArrow(run, rows.schema)
