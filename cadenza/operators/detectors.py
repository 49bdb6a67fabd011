"""Composite detectors and event builders: series in, event lists out."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions import timecode
from cadenza.operators import eventlist, folds, series
from cadenza.operators.matching import nearest
from cadenza.operators.runs import DETECTOR_IDS
from cadenza.sources.frames import colour_scores

#: Microseconds stand for seconds wherever a density window is taken.
_US = 1_000_000


def minimal_events(times: DataFrame, keys: list[str], time: str, emitted: str) -> DataFrame:
    """keys, time, kind of bare times."""
    return eventlist.first_wins(times, keys, time, emitted).select(*keys, F.col(time).alias("time"), F.lit("unknown").alias("kind"))


def spike_events(accepted: DataFrame, keys: list[str], step: str, spike: str, fps: float, emitted: str | None = None) -> DataFrame:
    """keys, time, frame, kind, value, metric: a score at step i is the change into frame i + 1, timed at i."""
    rows = accepted.withColumn("time", timecode.frame_time(step, fps)).withColumn("frame", F.col(step) + 1)
    return eventlist.first_wins(rows, keys, "time", emitted or step).select(*keys, "time", "frame", F.lit("unknown").alias("kind"), F.col(spike).alias("value"), F.lit("hsv_spike_ratio").alias("metric"))


def vector_events(kept: DataFrame, keys: list[str], pts: str, frame: str, score: str, emitted: str | None = None) -> DataFrame:
    """keys, time, frame, kind, value, metric at presentation times rounded to milliseconds."""
    rows = kept.withColumn("time", F.bround(pts, 3))
    return eventlist.first_wins(rows, keys, "time", emitted or frame).select(*keys, "time", F.col(frame).alias("frame"), F.lit("unknown").alias("kind"), F.col(score).alias("value"), F.lit("mv_score").alias("metric"))


def net_events(hard: DataFrame, gradual: DataFrame, keys: list[str], fps: float, strobe_guard: bool = True, window: float = 8, most: int = 8, merge: float = 4, keep: float = 2.5) -> DataFrame:
    """keys, time, frame, kind, value, metric, span_start, span_end from hard (frame, prob) and gradual (frame, prob, lo, hi).

    Hard candidates come first, so on equal rounded times they win; bursts are thinned last.
    """
    none = F.lit(None).cast("double")
    first = hard.select(*keys, "frame", "prob", F.lit("hard").alias("kind"), F.lit("transnet_peak_prob").alias("metric"), none.alias("span_start"), none.alias("span_end"), F.lit(0).alias("_side"))
    wide = F.col("hi") > F.col("lo")
    second = gradual.select(*keys, "frame", "prob", F.lit("gradual").alias("kind"), F.lit("transnet_gradual_prob").alias("metric"), F.when(wide, timecode.frame_time("lo", fps)).alias("span_start"), F.when(wide, timecode.frame_time("hi", fps)).alias("span_end"), F.lit(1).alias("_side"))
    rows = first.unionByName(second).withColumn("time", timecode.frame_time("frame", fps)).withColumn("_emitted", F.struct("_side", "frame"))
    events = eventlist.first_wins(rows, keys, "time", "_emitted").withColumn("_us", F.rint(F.col("time") * _US).cast("long"))
    if strobe_guard:
        calm = eventlist.dampen_bursts(events.select(*keys, "_us"), keys, "_us", int(window * _US / 2), most, int(merge * _US), int(keep * _US))
        events = events.join(calm, [*keys, "_us"], "left_semi")
    return events.select(*keys, "time", "frame", "kind", F.col("prob").alias("value"), "metric", "span_start", "span_end")


def detect_spikes(scores: DataFrame, keys: list[str], step: str = "i", score: str = "score", fps: float = 24.0, ratio: float = 3.0, floor: float = 0.045, radius: int = 15) -> DataFrame:
    """The colour-change detector over a score series."""
    return spike_events(series.spikes(scores, keys, step, score, radius, ratio, floor), keys, step, "spike", fps)


def detect_net(probs: DataFrame, keys: list[str], step: str = "frame", single: str = "single", allf: str = "allf", fps: float = 24.0, threshold: float = 0.4, height: float = 0.35, min_gap_s: float = 0.4, strobe_guard: bool = True, before: float | None = None) -> DataFrame:
    """The two-stream detector: scene starts of one stream, and peaks of the other that are not near what is accepted. Height zero turns the peaks off.

    With ``before``, that probability stands before the first step, which can then be a peak.
    """
    base = probs.select(*keys, F.col(step).alias("frame"), F.col(single).alias("single"), F.col(allf).alias("allf"))
    peaked = series.trailing_peak(base, keys, "frame", "single", 5, "prob")
    hard = series.scene_starts(peaked, keys, "frame", "single", threshold).select(*keys, "frame", "prob")
    gap = max(1, int(min_gap_s * fps))
    if height > 0:
        centres = folds.exclude_growing(series.local_maxima(base, keys, "frame", "allf", height, gap, before).select(*keys, "frame"), hard, keys, "frame", gap)
        bounds = series.spans(base, keys, "frame", "allf", height)
        gradual = centres.join(bounds, [*keys, "frame"]).select(*keys, "frame", F.col("allf").alias("prob"), F.col("span_lo").alias("lo"), F.col("span_hi").alias("hi"))
    else:
        gradual = base.limit(0).select(*keys, "frame", F.col("allf").alias("prob"), F.col("frame").alias("lo"), F.col("frame").alias("hi"))
    return net_events(hard, gradual, keys, fps, strobe_guard)


def detect_vectors(records: DataFrame, keys: list[str], keep: float = 0.3, early_weight: float = 0.5) -> DataFrame:
    """The codec detector over i, pts, kind, cov, bwd records: early intra steps that local evidence supports."""
    shared = records.withColumn("share", timecode.backward_share("cov", "bwd"))
    base = series.corroboration(series.inter_baseline(shared, keys, "i", "cov", F.col("kind") == "P"), keys, "i")
    intra = base.where("kind = 'I'")
    scored = series.earliness(intra, series.gop_profile(intra, keys, "pts"), keys, "pts")
    scored = scored.withColumn("mv_score", F.col("corroboration") + early_weight * F.col("earliness"))
    return vector_events(scored.where(F.col("mv_score") >= keep), keys, "pts", "i", "mv_score")


def label_candidates(probs: DataFrame, keys: list[str], step: str, heights: dict[str, float], kept: DataFrame, tol: int) -> DataFrame:
    """keys, step, strength, kept: local maxima of several streams, each at its own height or above, as one list.

    ``kept`` (keys, step) holds the cuts of the present list; the one candidate nearest to each, within ``tol``, is kept.
    """
    peaks = [series.local_maxima(probs, keys, step, stream, height).select(*keys, step, F.col(stream).alias("strength")) for stream, height in heights.items()]
    merged = eventlist.merge_streams(peaks, keys, step, "strength")
    chosen = nearest(kept, merged.select(*keys, step), keys, step, tol).where("match_time is not null")
    flags = chosen.select(*keys, F.col("match_time").alias(step), F.lit(True).alias("kept")).distinct()
    return merged.join(flags, [*keys, step], "left").na.fill(False, ["kept"])


def structural_refine(cuts: DataFrame, edges: DataFrame, keys: list[str], ratio: float = 3.0, window: float = 8, most: int = 8, merge: float = 4) -> DataFrame:
    """keys, time: cuts of dense regions stay only if the edge signal (step, time, value over its median) breaks within one step of them."""
    us = cuts.withColumn("_us", F.rint(F.col("time") * _US).cast("long"))
    marked = eventlist.dense_chains(us, keys, "_us", int(window * _US / 2), most, int(merge * _US))
    peak = F.max("value").over(series._w(keys, "step", -1, 1))
    signal = edges.withColumn("_peak", peak).withColumn("_us", F.rint(F.col("time") * _US).cast("long"))
    near = nearest(marked.where("in_region").select(*keys, "_us"), signal.select(*keys, "_us"), keys, "_us", 1 << 60)
    flash = near.join(signal.select(*keys, F.col("_us").alias("match_time"), "_peak"), [*keys, "match_time"]).where(F.col("_peak") < ratio)
    return marked.join(flash.select(*keys, "_us"), [*keys, "_us"], "left_anti").select(*keys, "time")


def detect_colour(frames: DataFrame, keys: list[str], step: str = "frame", pixels: str = "pixels", fps: float = 24.0, value_weight: float = 0.1, ratio: float = 3.0, floor: float = 0.045, radius: int = 15) -> DataFrame:
    """The colour-change detector from pixels: scores are numbered by the frame before the change."""
    scores = colour_scores(frames, keys, step, pixels, value_weight)
    numbered = scores.select(*keys, (F.col(step) - 1).alias(step), "score")
    return detect_spikes(numbered, keys, step, "score", fps, ratio, floor, radius)


def _timed(cuts: DataFrame, keys: list[str], step: str, fps: float) -> DataFrame:
    return minimal_events(cuts.withColumn("_t", timecode.frame_time(step, fps)), keys, "_t", step)


def detect_content(changes: DataFrame, keys: list[str], step: str = "frame", value: str = "change", fps: float = 24.0, threshold: float = 27.0, min_length: int = 15) -> DataFrame:
    """Fixed threshold on the mean change of 8-bit hue, saturation and value."""
    return _timed(series.content_cuts(changes, keys, step, value, threshold, min_length), keys, step, fps)


def detect_ratio(changes: DataFrame, keys: list[str], step: str = "frame", value: str = "change", fps: float = 24.0, adaptive_threshold: float = 3.0, min_content_val: float = 15.0, min_length: int = 15) -> DataFrame:
    """The same change against its neighbours' mean."""
    return _timed(series.ratio_cuts(changes, keys, step, value, adaptive_threshold, min_content_val, 2, min_length), keys, step, fps)


#: Detectors by name; each takes a table of its own kind of series and key columns, and settings by name.
REGISTRY: dict[str, Callable[..., DataFrame]] = {
    "torch-cpu": detect_spikes, "torch-cuda": detect_spikes, "transnet-cpu": detect_net, "transnet-cuda": detect_net, "motion-vectors": detect_vectors,
    "ffmpeg-cpu": minimal_events, "ffmpeg-cuda": minimal_events, "psd-content": detect_content, "psd-adaptive": detect_ratio,
}


def detect(name: str, table: DataFrame, keys: list[str], **settings: object) -> tuple[DataFrame, dict]:
    """(events, run): what a detector finds, and the run's row: its key, id, backend and the settings in force."""
    found = REGISTRY[name]
    given = inspect.signature(found).parameters
    own = {k: settings.get(k, p.default) for k, p in given.items() if k not in ("keys", next(iter(given)))}
    detector, backend = DETECTOR_IDS[name]
    return found(table, keys, **own), {"detector_key": name, "detector_id": detector, "backend": backend, "settings": own}
