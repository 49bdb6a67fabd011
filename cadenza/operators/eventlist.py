"""Algebra of event lists: dedupe, density thinning, region override, intervals, candidates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadenza.operators.folds import chains, thin


def first_wins(df: DataFrame, keys: list[str], key: str, emitted: str) -> DataFrame:
    """One row per key: the one emitted first."""
    w = Window.partitionBy(*keys, key).orderBy(emitted)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def density(df: DataFrame, keys: list[str], time: str, half: int, name: str = "near") -> DataFrame:
    """Events within ``half`` on either side, ends and the event itself included. ``time`` is an integer."""
    return df.withColumn(name, F.count(F.lit(1)).over(Window.partitionBy(*keys).orderBy(time).rangeBetween(-half, half)))


def dense_chains(df: DataFrame, keys: list[str], time: str, half: int, most: int, merge: int) -> DataFrame:
    """Adds ``chain`` and ``in_region``: a region starts at a dense event and goes on while events are dense or follow within ``merge``."""
    counted = density(df, keys, time, half, "_near").withColumn("_dense", F.col("_near") > most)
    w = Window.partitionBy(*keys).orderBy(time)
    broken = F.col("_since").isNull() | (~F.col("_dense") & (F.col("_since") >= merge))
    marked = chains(counted.withColumn("_since", F.col(time) - F.lag(time).over(w)), keys, time, broken)
    within = Window.partitionBy(*keys, "chain").orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("in_region", F.max("_dense").over(within)).drop("_near", "_dense", "_since")


def dense_regions(df: DataFrame, keys: list[str], time: str, half: int, most: int, merge: int) -> DataFrame:
    """keys, lo, hi, n of each dense region."""
    return dense_chains(df, keys, time, half, most, merge).where("in_region").groupBy(*keys, "chain").agg(F.min(time).alias("lo"), F.max(time).alias("hi"), F.count(F.lit(1)).alias("n")).drop("chain")


def dampen_bursts(df: DataFrame, keys: list[str], time: str, half: int, most: int, merge: int, keep: int) -> DataFrame:
    """keys, time: events outside dense regions as they are, inside only those ``keep`` apart."""
    marked = dense_chains(df.select(*keys, time), keys, time, half, most, merge)
    inside = thin(marked.where("in_region"), [*keys, "chain"], time, keep)
    return marked.where("not in_region").select(*keys, time).unionByName(inside.select(*keys, time))


def collapse_region(df: DataFrame, keys: list[str], time: str, lo: Column, hi: Column, keep: int) -> DataFrame:
    """keys, time: events in [lo, hi] thinned to ``keep`` apart, the others as they are."""
    marked = df.select(*keys, time, F.col(time).between(lo, hi).alias("_in"))
    return marked.where("not _in").select(*keys, time).unionByName(thin(marked.where("_in").select(*keys, time), keys, time, keep))


def override_regions(base: DataFrame, human: DataFrame, regions: DataFrame, keys: list[str], time: str) -> DataFrame:
    """keys, time, kind after all overrides in their order.

    ``regions``: keys, region_no, lo, hi, a few per key, as people draw them: they travel as one list.
    ``human``: keys, region_no, time. An event stands if no later
    override covers it: a base event if no region does, a human event in its own region if no region
    of a higher number does. The kind is ``movienet+human`` after one override and ``human`` after more.
    """
    events = base.select(*keys, time, F.lit(-1).alias("_no")).unionByName(human.select(*keys, time, F.col("region_no").cast("int").alias("_no")))
    held = regions.groupBy(*keys).agg(F.collect_list(F.struct(F.col("region_no").cast("int").alias("no"), "lo", "hi")).alias("_regions"))
    joined = events.join(held, keys, "left")
    covers = lambda r: (F.col(time) >= r["lo"]) & (F.col(time) <= r["hi"])
    wiped = F.coalesce(F.exists("_regions", lambda r: (r["no"] > F.col("_no")) & covers(r)), F.lit(False))
    own = (F.col("_no") < 0) | F.coalesce(F.exists("_regions", lambda r: (r["no"] == F.col("_no")) & covers(r)), F.lit(False))
    n = F.coalesce(F.size("_regions"), F.lit(0))
    kind = F.when(n <= 0, "movienet").when(n == 1, "movienet+human").otherwise("human")
    return joined.where(own & ~wiped).select(*keys, time, kind.alias("kind"))


def intervals(cuts: DataFrame, keys: list[str], time: str, duration: DataFrame, skip_empty: bool = True) -> DataFrame:
    """keys, shot_no, start, end: the stretches between successive bounds 0, cuts, duration.

    Numbers count every stretch; with ``skip_empty`` those that end where they start, or before, are left out after numbering.
    """
    bounds = cuts.select(*keys, F.col(time).cast("double").alias("start"), F.lit(1).alias("_side"))
    bounds = bounds.unionByName(duration.select(*keys, F.lit(0.0).alias("start"), F.lit(0).alias("_side")))
    bounds = bounds.unionByName(duration.select(*keys, F.col("duration").cast("double").alias("start"), F.lit(2).alias("_side")))
    w = Window.partitionBy(*keys).orderBy("_side", "start")
    cut = bounds.withColumn("end", F.lead("start").over(w)).withColumn("shot_no", F.row_number().over(w).cast("long")).where("end is not null")
    return (cut.where("end > start") if skip_empty else cut).select(*keys, "shot_no", "start", "end")


def ascending(df: DataFrame, keys: list[str], time: str, order: str) -> DataFrame:
    """Rows that break strictly ascending order, with ``problem``: duplicate or descending."""
    before = F.lag(time).over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("_b", before).where(F.col(time) <= F.col("_b")).withColumn("problem", F.when(F.col(time) == F.col("_b"), "duplicate").otherwise("descending")).drop("_b")


def merge_streams(streams: list[DataFrame], keys: list[str], order: str, value: str) -> DataFrame:
    """Union of candidate streams, the largest value for each step."""
    return reduce(DataFrame.unionByName, [s.select(*keys, order, value) for s in streams]).groupBy(*keys, order).agg(F.max(value).alias(value))


def candidate_gaps(df: DataFrame, keys: list[str], order: str, value: str, kept: str) -> DataFrame:
    """keys, gap_no, n, top: unkept candidates between successive kept ones, gaps counted by the kept ones before."""
    before = F.sum(F.col(kept).cast("int")).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("gap_no", before).where(~F.col(kept)).groupBy(*keys, "gap_no").agg(F.count(F.lit(1)).alias("n"), F.max(value).alias("top"))


def refine_steps(df: DataFrame, keys: list[str], time: str, delta: float, fps: float) -> DataFrame:
    """Frames that lie unseen between successive shown events."""
    after = F.lead(time).over(Window.partitionBy(*keys).orderBy(time))
    return df.withColumn("_a", after).where("_a is not null").withColumn("steps", F.greatest(F.lit(0), F.rint((F.col("_a") - F.col(time) - 2 * delta) * fps)).cast("long")).drop("_a")


def quota(df: DataFrame, label: str, order: list[str], n: int) -> DataFrame:
    """The first n rows of each label."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(label).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def build_events(df: DataFrame, keys: list[str], time: Column, emitted: str) -> DataFrame:
    """Rows with ``time``, deduped on it in order of emission."""
    return first_wins(df.withColumn("time", time), keys, "time", emitted)
