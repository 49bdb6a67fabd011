"""Readers and writers at the edges: shot lists, subtitle and log text, cut-list JSON, tables of projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadenza.functions import timecode

VIDEO_GLOB = "*.{mp4,mkv,mov,avi,webm}"


def shot_rows(lines: DataFrame, keys: list[str], line_no: str, text: str) -> DataFrame:
    """keys, start_frame, end_frame from lines of integers.

    Lines with fewer than two are left out; if each of the first ten others has six or more, the first is a shot number.
    """
    found = lines.withColumn("_n", F.expr(f"transform(regexp_extract_all(`{text}`, '-?[0-9]+', 0), x -> cast(x as bigint))")).where(F.size("_n") >= 2)
    w = Window.partitionBy(*keys)
    found = found.withColumn("_k", F.row_number().over(w.orderBy(line_no)))
    shift = F.min(F.when(F.col("_k") <= 10, (F.size("_n") >= 6).cast("int"))).over(w)
    return found.withColumn("_s", shift).select(*keys, F.element_at("_n", F.col("_s") + 1).alias("start_frame"), F.element_at("_n", F.col("_s") + 2).alias("end_frame"))


def read_shots(spark: SparkSession, path: str) -> DataFrame:
    """file, start_frame, end_frame of shot-list text files."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("line_no", "text"))
    return shot_rows(lines, ["file"], "line_no", "text")


def srt_cuts(text: Column) -> Column:
    """Distinct sorted start times of subtitle entries without the first."""
    stamps = F.regexp_extract_all(text, F.lit(r"([0-9]{2}:[0-9]{2}:[0-9]{2},[0-9]{3}) -->"), 1)
    part = lambda x, s, n: F.substring(x, s, n).cast("double")
    seconds = F.transform(stamps, lambda x: part(x, 1, 2) * 3600 + part(x, 4, 2) * 60 + part(x, 7, 2) + part(x, 10, 3) / 1000)
    starts = F.array_sort(F.array_distinct(seconds))
    return F.when(F.size(starts) > 1, F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(1)))).otherwise(F.slice(starts, 1, 0))


def showinfo_times(text: Column) -> Column:
    """Presentation times in a filter's log."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"pts_time:([0-9.]+)"), 1), lambda x: x.cast("double"))


def read_cut_lists(spark: SparkSession, path: str) -> DataFrame:
    """file, video, fps, t of cut-list JSON documents, one row per cut."""
    schema = "video string, fps double, cuts array<double>"
    docs = spark.read.schema(schema).option("multiLine", True).json(path)
    return docs.select(F.input_file_name().alias("file"), "video", "fps", F.explode("cuts").alias("t"))


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """name, imdb, base, override_no, override of a canonical-sources document; movies without overrides keep one row."""
    spec = "struct<kind:string,path:string,region:array<double>>"
    docs = spark.read.schema(f"movies array<struct<name:string,imdb:string,video:string,base:struct<kind:string,path:string>,overrides:array<{spec}>>>").option("multiLine", True).json(path)
    movies = docs.select(F.explode("movies").alias("m"))
    return movies.select("m.name", "m.imdb", "m.base", F.posexplode_outer("m.overrides").alias("override_no", "override"))


def discover(spark: SparkSession, path: str) -> DataFrame:
    """path, size_bytes, mtime_utc of video files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", VIDEO_GLOB).load(path)
    return files.select("path", F.col("length").alias("size_bytes"), F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("mtime_utc"))


def synthetic_scores(spark: SparkSession, films: int, steps: int, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(film, i, score) and its true (film, i): shots of 36 to 135 steps; every fourth shot holds a flash of moderate score that is no cut."""
    grid = spark.range(films * steps).select(F.floor(F.col("id") / steps).alias("film"), (F.col("id") % steps).alias("i"))
    shot = F.floor(F.col("i") / 135)
    at = shot * 135 + 36 + F.pmod(F.xxhash64(F.lit(seed), "film", shot), F.lit(90))
    noise = F.pmod(F.xxhash64(F.lit(seed + 1), "film", "i"), F.lit(1000)) / 1000 * 0.02
    flash = (shot % 4 == 3) & (F.col("i") == at + 5)
    score = F.when(F.col("i") == at, 0.6 + noise).when(flash, 0.03 + noise).otherwise(noise)
    rows = grid.withColumn("score", score).withColumn("cut", F.col("i") == at)
    return rows.select("film", "i", "score"), rows.where("cut").select("film", "i")


def keyword_id(text: Column, table: list[tuple[str, str]]) -> Column:
    """The id of the first keyword, in table order, that the lower-cased text contains."""
    out = F.lit(None).cast("string")
    for keyword, found in reversed(table):
        out = F.when(F.lower(text).contains(keyword.lower()), F.lit(found)).otherwise(out)
    return out


def csv_rows(cuts: DataFrame, keys: list[str], time: str, fps: float) -> DataFrame:
    """keys, cut_index, time_seconds, timecode: what the CSV sink writes under that header."""
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(time)).cast("long")
    return cuts.select(*keys, number.alias("cut_index"), F.format_string("%.3f", F.bround(time, 3)).alias("time_seconds"), timecode.smpte(time, fps).alias("timecode"))


def srt_entries(shots: DataFrame, keys: list[str], label: str = "Shot") -> DataFrame:
    """keys, shot_no, entry of subtitle text from intervals; numbers keep counting over intervals left out."""
    clock = F.concat_ws(" --> ", timecode.srt_time("start"), timecode.srt_time("end"))
    return shots.select(*keys, "shot_no", F.concat(F.col("shot_no").cast("string"), F.lit("\n"), clock, F.lit(f"\n{label} "), F.col("shot_no").cast("string"), F.lit("\n\n")).alias("entry"))


def edl_entries(shots: DataFrame, keys: list[str], fps: float) -> DataFrame:
    """keys, shot_no, entry of an edit decision list; empty intervals belong in it."""
    a, b = timecode.smpte("start", fps), timecode.smpte("end", fps)
    line = F.concat(F.format_string("%03d", F.col("shot_no").cast("int")), F.lit("  AX       V     C        "), F.concat_ws(" ", a, b, a, b), F.lit("\n"))
    return shots.select(*keys, "shot_no", line.alias("entry"))


def write_entries(entries: DataFrame, keys: list[str], path: str, head: str = "") -> None:
    """One text row per key under ``path``, entries in order, behind ``head``; partitioned by the first key."""
    whole = entries.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("shot_no", "entry"))), lambda x: x["entry"]), "").alias("value"))
    whole.select(keys[0], F.concat(F.lit(head), "value").alias("value")).write.partitionBy(keys[0]).option("lineSep", "\n").text(path)


def write_csv(cuts: DataFrame, keys: list[str], time: str, fps: float, path: str) -> None:
    csv_rows(cuts, keys, time, fps).repartition(*keys).sortWithinPartitions(*keys, "cut_index").write.partitionBy(*keys).option("header", True).csv(path)
