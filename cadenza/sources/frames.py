"""Frames, block vectors and probe reports as tables: what decoders leave behind, and the scores that follow from it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadenza.functions import timecode

#: Bytes of pixels in one batch of frames.
_BATCH_BYTES = 8 << 20


def read_raw(spark: SparkSession, path: str, width: int, height: int, channels: int = 3, first: int = 0, last: int | None = None) -> DataFrame:
    """path, frame, pixels (binary) of raw video files: whole frames of a fixed size; a torn last one is left out.

    Only frames from ``first`` to ``last`` are cut out. Any file system that Spark reads will do.
    """
    size = width * height * channels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = memoryview(raw.as_buffer())
                end = len(data) // size if last is None else min(len(data) // size, last + 1)
                step = max(1, _BATCH_BYTES // size)
                for at in range(first, end, step):
                    frames = range(at, min(at + step, end))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(frames)), pa.array(frames, pa.int64()), pa.array([bytes(data[f * size : (f + 1) * size]) for f in frames], pa.binary())], ["path", "frame", "pixels"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, frame long, pixels binary")


def region_frames(start: float, end: float, pad: float, fps: float) -> tuple[int, int]:
    """First and last frame of a region with ``pad`` seconds on either side."""
    return max(0, int(round((start - pad) * fps))), int(round((end + pad) * fps))


def probe_info(report: Column) -> Column:
    """struct<fps, n_frames, width, height> of a prober's JSON report; without a frame count, duration times rate; null for text that is none."""
    stream = F.from_json(report, "streams array<struct<r_frame_rate:string,nb_frames:string,width:int,height:int,duration:string>>")["streams"][0]
    rate = F.split(stream["r_frame_rate"], "/")
    fps = rate[0].try_cast("double") / F.nullif(rate[1].try_cast("double"), F.lit(0.0))
    counted = F.nullif(stream["nb_frames"].try_cast("long"), F.lit(0).cast("long"))
    n = F.coalesce(counted, F.rint(F.coalesce(stream["duration"].try_cast("double"), F.lit(0.0)) * fps).cast("long"))
    return F.when(stream.isNotNull(), F.struct(fps.alias("fps"), n.alias("n_frames"), stream["width"].alias("width"), stream["height"].alias("height")))


def block_coverage(frames: DataFrame, blocks: DataFrame, keys: list[str], area: Column | float) -> DataFrame:
    """Rows of ``frames`` that have a ``pts``, with cov, fwd, bwd: shares of the frame that blocks predict, in all, from the past, from the future.

    ``blocks``: keys, frame, w, h, source (below zero: past). A frame without blocks has zeros.
    """
    size = F.col("w").cast("long") * F.col("h").cast("long")
    sums = blocks.groupBy(*keys, "frame").agg(F.sum(F.when(F.col("source") < 0, size)).alias("_past"), F.sum(F.when(F.col("source") > 0, size)).alias("_future"))
    joined = frames.where("pts is not null").join(sums, [*keys, "frame"], "left")
    share = lambda c: F.coalesce(F.col(c), F.lit(0)) / area
    return joined.withColumn("fwd", share("_past")).withColumn("bwd", share("_future")).withColumn("cov", F.col("fwd") + F.col("bwd")).drop("_past", "_future")


def colour_scores(frames: DataFrame, keys: list[str], order: str, pixels: str, value_weight: float = 0.1) -> DataFrame:
    """keys, order, score: weighted mean change of hue, saturation and value from the frame before.

    ``pixels`` are red, green and blue in turn, from 0 to 1. Hue and saturation share what ``value_weight``
    leaves of one; the mean is over channels as well as pixels. A sequence's first frame has no score.
    """
    own = (1 - value_weight) / 2
    at = lambda k: F.get(pixels, k).cast("double")
    picture = F.transform(F.sequence(F.lit(0), F.floor(F.size(pixels) / 3).cast("int") - 1), lambda k: timecode.rgb_to_hsv(at(3 * k), at(3 * k + 1), at(3 * k + 2)))
    seen = frames.where(F.size(pixels) >= 3).select(*keys, order, picture.alias("_p"))
    both = seen.withColumn("_b", F.lag("_p").over(Window.partitionBy(*keys).orderBy(order))).where("_b is not null")
    change = F.zip_with("_p", "_b", lambda a, b: own * timecode.hue_distance(a["h"], b["h"]) + own * F.abs(a["s"] - b["s"]) + value_weight * F.abs(a["v"] - b["v"]))
    return both.select(*keys, order, (F.aggregate(change, F.lit(0.0), lambda a, x: a + x) / (3 * F.size("_p"))).alias("score"))


def load_cuts(specs: DataFrame, lists: DataFrame, path: str = "path") -> DataFrame:
    """``specs`` with ``cuts``: the sorted list of its file; null for kind ``none``, no path or a file that is not there. ``lists``: path, cuts."""
    found = lists.select(F.col(path).alias("_path"), F.array_sort("cuts").alias("cuts"))
    return specs.join(found, (F.col(path) == F.col("_path")) & F.col("kind").isNotNull() & (F.col("kind") != "none"), "left").drop("_path")


def reference_cuts(shots: DataFrame, info: DataFrame, keys: list[str], start: str = "start_frame", order: str = "shot_no") -> DataFrame:
    """keys, t: the starts of all shots but a film's first, by its own rate; a rate of zero or none is 24. Films without shots have no rows. ``info``: keys, fps."""
    later = shots.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_n > 1")
    rate = F.coalesce(F.nullif(F.col("fps").cast("double"), F.lit(0.0)), F.lit(24.0))
    return later.join(info.select(*keys, "fps"), keys, "left").select(*keys, timecode.frame_time(start, rate).alias("t"))


def region_intervals(cuts: DataFrame, regions: DataFrame, keys: list[str], time: str) -> DataFrame:
    """keys, shot_no, start, end between a region's start, its cuts and its end; empty intervals stay. ``regions``: keys, lo, hi."""
    side = lambda df, t, n: df.select(*keys, F.col(t).cast("double").alias("start"), F.lit(n).alias("_side"))
    bounds = side(regions, "lo", 0).unionByName(side(cuts, time, 1)).unionByName(side(regions, "hi", 2))
    w = Window.partitionBy(*keys).orderBy("_side", "start")
    return bounds.withColumn("end", F.lead("start").over(w)).withColumn("shot_no", F.row_number().over(w).cast("long")).where("end is not null").select(*keys, "shot_no", "start", "end")


def candidate_documents(candidates: DataFrame, sessions: DataFrame, keys: list[str]) -> DataFrame:
    """keys, document of labelling sessions: their candidates in time order with every other column. ``sessions``: keys, video, name, start, end, fps."""
    rest = [c for c in candidates.columns if c not in keys and c != "time"]
    lists = candidates.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("time", *rest))).alias("candidates"))
    return sessions.join(lists, keys, "left").select(*keys, F.to_json(F.struct("video", "name", "start", "end", "fps", "candidates")).alias("document"))


def canonical_results(resolved: DataFrame, movies: DataFrame, key: str) -> DataFrame:
    """key, entry (JSON) of every movie: its list, count and source, or that there is none yet. ``movies``: key, name, video, status; ``resolved``: key, time, kind."""
    lists = resolved.groupBy(key).agg(F.array_sort(F.collect_list(F.col("time").cast("double"))).alias("cuts"), F.max("kind").alias("source"))
    joined = movies.join(lists, key, "left")
    full = F.to_json(F.struct("name", "video", "source", F.size("cuts").alias("n_cuts"), "cuts"))
    none = F.to_json(F.struct("name", F.lit("none").alias("source"), F.coalesce("status", F.lit("")).alias("status")))
    return joined.select(key, F.when(F.col("cuts").isNotNull(), full).otherwise(none).alias("entry"))
