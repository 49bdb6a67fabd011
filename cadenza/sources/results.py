"""Result documents and the remaining readers: image streams, sessions, canonical lists, run summaries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadenza.functions import timecode

_START, _END = b"\xff\xd8", b"\xff\xd9"


def split_images(stream: Column) -> Column:
    """The JPEG images of a concatenated stream, cut at their start and end markers; a torn tail is left out."""

    @F.pandas_udf("array<binary>")
    def run(raw: pd.Series) -> pd.Series:
        out = []
        for data in raw:
            found, at = [], 0
            while data is not None and (start := data.find(_START, at)) >= 0 and (end := data.find(_END, start + 2)) >= 0:
                found.append(bytes(data[start : end + 2]))
                at = end + 2
            out.append(found)
        return pd.Series(out)

    return run(stream)


def sessions(spark: SparkSession, root: str) -> DataFrame:
    """name and path of label sessions below a folder: ``label_*`` directories that hold candidates."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "candidates.json").load(root)
    found = files.select(F.regexp_extract("path", r"/label_([A-Za-z0-9_.-]+)/candidates\.json$", 1).alias("name"), "path")
    return found.where("name <> ''").orderBy("name")


def score_stream(frames: DataFrame, keys: list[str], batch: int = 256) -> DataFrame:
    """Adds ``batch_no``: frames in batches of equal size, as an inference step takes them."""
    order = F.row_number().over(Window.partitionBy(*keys).orderBy("frame")) - 1
    return frames.withColumn("batch_no", F.floor(order / batch))


def median_image(frames: DataFrame, keys: list[str], order: str, pixels: str, low: int, high: int) -> DataFrame:
    """Adds ``median``: per pixel, the median over the steps from ``low`` to ``high`` around each."""
    near = F.collect_list(pixels).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(low, high))
    n = F.size("_near")

    def middle(k: Column) -> Column:
        values = F.array_sort(F.transform("_near", lambda image: F.get(image, k).cast("double")))
        return (F.element_at(values, F.floor((n + 1) / 2).cast("int")) + F.element_at(values, F.floor(n / 2).cast("int") + 1)) / 2

    return frames.withColumn("_near", near).withColumn("median", F.transform(F.sequence(F.lit(0), F.size(pixels) - 1), middle)).drop("_near")


def label_frames(frame: Column, delta: Column | int, n_frames: Column) -> Column:
    """struct<before, after> of the frames shown around a candidate, kept within the film."""
    d = F.lit(delta) if isinstance(delta, int) else delta
    return F.struct(F.greatest(F.lit(0), frame - d).alias("before"), F.least(n_frames - 1, frame + d).alias("after"))


def grid_place(index: Column, columns: int) -> Column:
    """struct<row, column> of a contact sheet."""
    return F.struct(F.floor(index / columns).alias("row"), F.pmod(index, F.lit(columns)).alias("column"))


def run_summaries(runs: DataFrame, events: DataFrame, keys: list[str]) -> DataFrame:
    """keys, cuts, n_cuts, analysed_fps, realtime_x: a run without its scores, rates rounded."""
    cuts = events.groupBy(*keys).agg(F.array_sort(F.collect_list("time")).alias("cuts"))
    rate = timecode.throughput("n_frames", "elapsed")
    joined = runs.join(cuts, keys, "left").withColumn("cuts", F.coalesce("cuts", F.array().cast("array<double>")))
    return joined.select(*keys, "cuts", F.size("cuts").alias("n_cuts"), F.round(rate, 1).alias("analysed_fps"), F.round(rate / F.col("fps"), 2).alias("realtime_x"))


def canonical_documents(kept: DataFrame, regions: DataFrame, keys: list[str]) -> DataFrame:
    """keys, document: the region and its kept times in order, as JSON. ``kept``: keys, time; ``regions``: keys, lo, hi, fps."""
    cuts = kept.groupBy(*keys).agg(F.array_sort(F.collect_list(F.col("time").cast("double"))).alias("cuts"))
    joined = regions.join(cuts, keys, "left")
    document = F.struct(F.array("lo", "hi").alias("region"), "fps", F.coalesce("cuts", F.array().cast("array<double>")).alias("cuts"))
    return joined.select(*keys, F.to_json(document).alias("document"))


def truth_documents(shots: DataFrame, keys: list[str], fps: float) -> DataFrame:
    """keys, document of ground truth from shots: cuts are the starts of all shots after the first."""
    order = Window.partitionBy(*keys).orderBy("start_frame", "end_frame")
    rows = shots.withColumn("_n", F.row_number().over(order))
    later = F.array_sort(F.collect_list(F.when(F.col("_n") > 1, timecode.frame_time("start_frame", fps))))
    found = rows.groupBy(*keys).agg(later.alias("cuts"), (F.max("end_frame") + 1).alias("n_frames"))
    return found.select(*keys, F.to_json(F.struct(F.lit(float(fps)).alias("fps"), "n_frames", F.bround(F.col("n_frames") / fps, 3).alias("duration_s"), "cuts")).alias("document"))
