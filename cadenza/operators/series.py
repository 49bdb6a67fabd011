"""Detectors over score series: one row per step, keyed by a sequence and ordered within it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadenza.operators.folds import chains, thin


def _w(keys: list[str], order: str, low: int, high: int):
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(low, high)


def frame_difference(df: DataFrame, keys: list[str], order: str, vector: str, name: str = "score") -> DataFrame:
    """Mean absolute difference to the step before; a sequence's first step has none and is left out."""
    before = F.lag(vector).over(Window.partitionBy(*keys).orderBy(order))
    total = F.aggregate(F.zip_with(vector, "_before", lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda a, x: a + x)
    return df.withColumn("_before", before).where("_before is not null").withColumn(name, total / F.size(vector)).drop("_before")


def neighbour_median(value: str, keys: list[str], order: str, radius: int) -> Column:
    """Median of up to ``radius`` steps on either side without the step itself, zero where there are none."""
    near = F.sort_array(F.concat(F.collect_list(value).over(_w(keys, order, -radius, -1)), F.collect_list(value).over(_w(keys, order, 1, radius))))
    n = F.size(near)
    middle = (F.element_at(near, F.floor((n + 1) / 2).cast("int")) + F.element_at(near, F.floor(n / 2).cast("int") + 1)) / 2
    return F.when(n > 0, middle).otherwise(0.0)


def adaptive_spikes(df: DataFrame, keys: list[str], order: str, value: str, radius: int = 15, ratio: float = 3.0, floor: float = 0.045) -> DataFrame:
    """Steps whose score reaches the floor and ``ratio`` times the median around them, with ``spike``, that multiple. The first step never counts."""
    base = df.withColumn("_median", neighbour_median(value, keys, order, radius)).withColumn("_first", F.min(order).over(Window.partitionBy(*keys)))
    base = base.where(F.col(order) > F.col("_first")).withColumn("spike", F.col(value) / (F.col("_median") + 1e-6))
    return base.where((F.col(value) >= floor) & (F.col(value) >= ratio * (F.col("_median") + 1e-6))).drop("_median", "_first")


def spikes(df: DataFrame, keys: list[str], order: str, value: str, radius: int = 15, ratio: float = 3.0, floor: float = 0.045, gap: int = 4) -> DataFrame:
    """Adaptive spikes at least ``gap`` steps apart, greedily from the start."""
    return thin(adaptive_spikes(df, keys, order, value, radius, ratio, floor), keys, order, gap, [value, "spike"])


def local_maxima(df: DataFrame, keys: list[str], order: str, value: str, height: float, gap: int = 1, before: float | None = None) -> DataFrame:
    """Inner steps at ``height`` or above, not below the step before and above the one after, ``gap`` apart. Of a plateau the last step counts.

    With ``before``, that value stands before the first step, which can then count too.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    near = df.withColumn("_b", F.lag(value, 1, before).over(w)).withColumn("_a", F.lead(value).over(w))
    found = near.where((F.col(value) >= height) & (F.col(value) >= F.col("_b")) & (F.col(value) > F.col("_a"))).drop("_b", "_a")
    return thin(found, keys, order, gap, [value])


def _spaced(df: DataFrame, good: Column, keys: list[str], order: str, gap: int, payload: list[str]) -> DataFrame:
    """Good steps at least ``gap`` after the last kept, or after the sequence's first step, which is never one."""
    first = F.col(order) == F.min(order).over(Window.partitionBy(*keys))
    rows = df.withColumn("_first", first).where(F.col("_first") | good)
    return thin(rows, keys, order, gap, ["_first", *payload]).where("not _first").drop("_first")


def content_cuts(df: DataFrame, keys: list[str], order: str, value: str, threshold: float = 27.0, min_length: int = 15) -> DataFrame:
    """Steps whose change reaches a fixed threshold, scenes at least ``min_length`` long."""
    return _spaced(df, F.col(value) >= threshold, keys, order, min_length, [value])


def ratio_cuts(df: DataFrame, keys: list[str], order: str, value: str, ratio: float = 3.0, least: float = 15.0, radius: int = 2, min_length: int = 15) -> DataFrame:
    """Steps whose change is ``ratio`` times the mean of the ``radius`` steps on either side and reaches ``least``.

    Steps without all those neighbours do not count; beside neighbours without change any change is 255 fold.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    near = [F.lag(value, k).over(w) for k in range(1, radius + 1)] + [F.lead(value, k).over(w) for k in range(1, radius + 1)]
    mean = sum(near[1:], near[0]) / (2 * radius)
    times = F.when(F.abs("_mean") < 1e-5, F.when(F.col(value) >= least, 255.0).otherwise(0.0)).otherwise(F.least(F.col(value) / F.col("_mean"), F.lit(255.0)))
    good = F.col("_mean").isNotNull() & (times >= ratio) & (F.col(value) >= least)
    return _spaced(df.withColumn("_mean", mean), good, keys, order, min_length, [value])


def trailing_peak(df: DataFrame, keys: list[str], order: str, value: str, k: int = 5, name: str = "peak") -> DataFrame:
    """Largest value of a step and the ``k`` before it."""
    return df.withColumn(name, F.max(value).over(_w(keys, order, -k, 0)))


def runs(df: DataFrame, keys: list[str], order: str, inside: Column) -> DataFrame:
    """keys, run_start, run_end, run_length of maximal stretches of successive steps where ``inside`` holds."""
    marked = chains(df.withColumn("_in", F.coalesce(inside, F.lit(False))), keys, order, ~F.col("_in"), "_run")
    return marked.where("_in").groupBy(*keys, "_run").agg(F.min(order).alias("run_start"), F.max(order).alias("run_end"), F.count(F.lit(1)).alias("run_length")).drop("_run")


def spans(df: DataFrame, keys: list[str], order: str, value: str, height: float) -> DataFrame:
    """Each step at ``height`` or above with the bounds of its run: span_lo, span_hi."""
    marked = chains(df.withColumn("_in", F.coalesce(F.col(value) >= height, F.lit(False))), keys, order, ~F.col("_in"), "_run").where("_in")
    w = Window.partitionBy(*keys, "_run")
    return marked.withColumn("span_lo", F.min(order).over(w)).withColumn("span_hi", F.max(order).over(w)).drop("_in", "_run")


def scene_starts(df: DataFrame, keys: list[str], order: str, value: str, threshold: float) -> DataFrame:
    """First step after each run above the threshold: where a new scene begins. A run that ends the sequence begins none."""
    w = Window.partitionBy(*keys).orderBy(order)
    above = F.coalesce(F.lag(value).over(w) > threshold, F.lit(False))
    return df.withColumn("_was", above).where(F.col("_was") & ~(F.col(value) > threshold)).drop("_was")


def inter_baseline(df: DataFrame, keys: list[str], order: str, value: str, counted: Column, before: int = 25, after: int = 24, name: str = "baseline") -> DataFrame:
    """Rolling median over the counted steps only (window positions among those); null on the others."""
    side = df.withColumn("_counted", F.coalesce(counted, F.lit(False)))
    w = Window.partitionBy(*keys, "_counted").orderBy(order).rowsBetween(-before, after)
    return side.withColumn(name, F.when(F.col("_counted"), F.percentile(value, F.lit(0.5)).over(w))).drop("_counted")


def corroboration(df: DataFrame, keys: list[str], order: str, kind: str = "kind", cov: str = "cov", share: str = "share", baseline: str = "baseline") -> DataFrame:
    """Largest local evidence from two steps before to three after: lopsided B steps, P steps that fall below their baseline."""
    own = F.when((F.col(kind) == "B") & (F.col(cov) > 0.05), 2 * F.abs(F.col(share) - 0.5)).when((F.col(kind) == "P") & (F.col(baseline) > 0) & (F.col(cov) < F.col(baseline)), 1 - F.col(cov) / F.col(baseline)).otherwise(0.0)
    return df.withColumn("_own", own).withColumn("corroboration", F.max("_own").over(_w(keys, order, -2, 3))).drop("_own")


def gop_profile(intra: DataFrame, keys: list[str], time: str) -> DataFrame:
    """keys, n_intra, keyint, regularity of the intervals between intra steps; sequences with fewer than three have none."""
    w = Window.partitionBy(*keys).orderBy(time)
    gaps = intra.withColumn("_gap", F.col(time) - F.lag(time).over(w))
    whole = gaps.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_intra"), F.percentile("_gap", F.lit(0.99)).alias("_p99"), F.max("_gap").alias("_max"), F.percentile("_gap", F.lit(0.5)).alias("_median")).where("n_intra >= 3")
    near = gaps.where("_gap is not null").join(whole.select(*keys, "_median"), keys).groupBy(*keys).agg(F.avg((F.abs(F.col("_gap") - F.col("_median")) < 0.05).cast("double")).alias("regularity"))
    return whole.join(near, keys).select(*keys, "n_intra", F.coalesce(F.nullif("_p99", F.lit(0.0)), F.col("_max").cast("double")).alias("keyint"), "regularity")


def earliness(intra: DataFrame, profile: DataFrame, keys: list[str], time: str) -> DataFrame:
    """How early each intra step comes, from 0 (on time, and the first) to 1."""
    gap = F.coalesce(F.col(time) - F.lag(time).over(Window.partitionBy(*keys).orderBy(time)), F.col("keyint"))
    return intra.join(profile.select(*keys, "keyint"), keys).withColumn("earliness", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - gap / F.col("keyint")))).drop("keyint")


def clip_peak(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.max(v).alias(f"max_{v}") for v in values])


def self_normalised(df: DataFrame, keys: list[str], value: str, name: str = "normalised") -> DataFrame:
    """Value over its sequence's median."""
    return df.withColumn(name, F.col(value) / (F.percentile(value, F.lit(0.5)).over(Window.partitionBy(*keys)) + 1e-6))
