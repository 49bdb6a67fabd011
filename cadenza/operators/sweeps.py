"""Sweeps over thresholds and parameters, and scoring of whole corpora: every combination in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadenza.functions import timecode
from cadenza.operators import align, eventlist, matching


def fired_share(clips: DataFrame, label: str, value: str, thresholds: Sequence[float]) -> DataFrame:
    """thr, label, fired, n: the share of each class above each threshold; recall of one class is false fire of another.

    Thresholds go through as one array per row and combine before the shuffle.
    """
    rows = clips.withColumn("thr", F.explode(F.array(*[F.lit(float(x)) for x in thresholds])))
    return rows.groupBy("thr", label).agg(F.avg((F.col(value) > F.col("thr")).cast("double")).alias("fired"), F.count(F.lit(1)).alias("n"))


def first_firing(clips: DataFrame, keys: list[str], value: str, thresholds: Sequence[float]) -> DataFrame:
    """keys, thr: the highest threshold that a clip's value passes, null if none."""
    passed = F.filter(F.array(*[F.lit(float(x)) for x in thresholds]), lambda x: F.col(value) > x)
    return clips.groupBy(*keys).agg(F.max(F.array_max(passed)).alias("thr"))


def feature_stats(candidates: DataFrame, flag: str, features: Sequence[str]) -> DataFrame:
    """feature, flag, mean, low, high of each feature among the candidates that the flag admits and those it does not."""
    long = candidates.select(flag, F.explode(F.create_map(*[x for f in features for x in (F.lit(f), F.col(f).cast("double"))])).alias("feature", "_v"))
    return long.groupBy("feature", flag).agg(F.avg("_v").alias("mean"), F.min("_v").alias("low"), F.max("_v").alias("high"))


def grid_scores(candidates: DataFrame, truth: DataFrame, keys: list[str], time: str, tol: int, least: Sequence[float], below: Sequence[float], spacing: Sequence[int], first: str, second: str, half: int, most: int, merge: int) -> DataFrame:
    """combo, tp, n_pred, n_truth, precision, recall, f1 for every combination of three parameters.

    Kept are candidates whose ``first`` reaches the first parameter and whose ``second`` stays below the
    second; a third above zero thins dense regions to that spacing. Combinations are numbered in the
    order of nested loops. A row goes to the combinations that admit it, so one matching serves all.
    """
    spark = candidates.sparkSession
    combos = [(i, float(a), float(b), int(c)) for i, (a, b, c) in enumerate((a, b, c) for a in least for b in below for c in spacing)]
    table = F.broadcast(spark.createDataFrame(combos, "combo int, least double, below double, spacing long"))  # one row per combination
    admitted = candidates.join(table, (F.col(first) >= F.col("least")) & (F.col(second) < F.col("below")))
    own = [*keys, "combo"]
    kept = admitted.where("spacing = 0").select(*own, time)
    for gap in sorted({c for c in spacing if c}):
        kept = kept.unionByName(eventlist.dampen_bursts(admitted.where(F.col("spacing") == gap).select(*own, time), own, time, half, most, merge, gap))
    wanted = truth.select(*keys, time).join(F.broadcast(table.select("combo")))
    met = matching.greedy_match(kept, wanted, own, time, tol)
    sizes = table.select("combo").join(kept.groupBy("combo").agg(F.count(F.lit(1)).alias("n_pred")), "combo", "left").join(met.groupBy("combo").agg(F.count(F.lit(1)).alias("tp")), "combo", "left").na.fill(0)
    total = truth.agg(F.count(F.lit(1)).alias("n_truth"))
    p = F.when(F.col("n_pred") > 0, F.col("tp") / F.col("n_pred")).otherwise(1.0)
    r = F.when(F.col("n_truth") > 0, F.col("tp") / F.col("n_truth")).otherwise(1.0)
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    joined = sizes.join(F.broadcast(total)).join(table, "combo")
    return joined.select("combo", "least", "below", "spacing", "tp", "n_pred", "n_truth", F.bround(p, 3).alias("precision"), F.bround(r, 3).alias("recall"), F.bround(f1, 3).alias("f1"))


def grid_best(scored: DataFrame) -> DataFrame:
    """The combination with the best F1, the first of several."""
    return scored.orderBy(F.desc("f1"), "combo").limit(1)


def track_length(predicted: DataFrame, truth: DataFrame, keys: list[str], time: str) -> DataFrame:
    """keys, duration: five seconds past the last event of either list."""
    both = predicted.select(*keys, time).unionByName(truth.select(*keys, time))
    return both.groupBy(*keys).agg((F.max(time) + 5).alias("duration"))


def corpus_scores(films: DataFrame, reference: DataFrame, predicted: DataFrame, keys: list[str], time: str = "t", tol: float = 0.5) -> DataFrame:
    """keys, ref, pred, precision, recall, f1, sync_rate, scale, offset of every film that has both lists.

    ``reference`` times are aligned to the film's own, remapped and, where not negative, matched. Films
    without an id or either list are skipped by the joins.
    """
    known = films.select(*keys).where(" and ".join(f"`{k}` is not null" for k in keys)).distinct()
    synced = align.synchronised(align.paired(reference, predicted, keys, time).join(known, keys, "left_semi"), keys, tol)
    moved = F.filter(F.transform("_r", lambda t: timecode.affine(t, F.col("scale"), F.col("offset"))), lambda t: t >= 0)
    scored = matching.matched_lists(synced.withColumn("_r", moved), "_m", "_r", tol)
    figures = matching.ratios(F.col("tp"), F.col("your_cuts"), F.size("_r"))
    return scored.select(*keys, *figures, F.col("ref_cuts").alias("ref"), F.col("your_cuts").alias("pred"), F.col("match_rate").alias("sync_rate"), "scale", "offset")


def side_by_side(lists: dict[str, DataFrame], truth: DataFrame, keys: list[str], time: str, tol: int | float) -> DataFrame:
    """keys, n_truth, and for every named event list its n, precision, recall and f1; null where a film has no such list."""
    out = truth.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_truth"))
    for name, events in lists.items():
        here = events.select(*keys).distinct()
        wanted = truth.join(here, keys, "left_semi")
        scored = matching.scores(matching.greedy_match(events, wanted, keys, time, tol), events, wanted, keys).join(here, keys, "left_semi")
        out = out.join(scored.select(*keys, (F.col("tp") + F.col("fp")).alias(f"{name}_n"), *[F.col(c).alias(f"{name}_{c}") for c in ("precision", "recall", "f1")]), keys, "left")
    return out


def scaling(runs: DataFrame, k: str, n_frames: str, wall: str, fps: str) -> DataFrame:
    """k, aggregate_fps, streams, scaling: frames of k concurrent streams per second, in units of real time and of one stream's rate."""
    rate = runs.select(k, timecode.throughput(F.col(k) * F.col(n_frames), F.col(wall)).alias("aggregate_fps"), F.col(fps).alias("_fps"))
    base = F.first("aggregate_fps").over(Window.orderBy(k))  # one row per level of concurrency
    return rate.select(k, "aggregate_fps", (F.col("aggregate_fps") / F.col("_fps")).alias("streams"), (F.col("aggregate_fps") / base).alias("scaling"))


def verdicts(cuts: DataFrame, calm: DataFrame, kept: DataFrame, keys: list[str], time: str) -> DataFrame:
    """keys, time, verdict: ``KEEP`` where the last stage keeps a cut, ``burst`` where only the first did, else ``flash``."""
    mark = lambda df, name: df.select(*keys, time).distinct().withColumn(name, F.lit(True))
    joined = cuts.join(mark(calm, "_calm"), [*keys, time], "left").join(mark(kept, "_kept"), [*keys, time], "left")
    return joined.select(*keys, time, F.when(F.col("_kept"), "KEEP").when(F.col("_calm"), "burst").otherwise("flash").alias("verdict"))


def hybrid_filter(cuts: DataFrame, keys: list[str], time: str, alike: Column, thresh: float, half: int, most: int, merge: int, keep: int) -> DataFrame:
    """keys, time, verdict: cuts whose two sides are not alike, then thinned where dense; see ``verdicts``."""
    calm = cuts.where(alike < thresh).select(*keys, time)
    return verdicts(cuts.select(*keys, time), calm, eventlist.dampen_bursts(calm, keys, time, half, most, merge, keep), keys, time)
