"""Queries of readers, writers and scalar projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza import sources
from cadenza.functions import timecode
from cadenza.plans.list_queries import BOUNDS, shots
from cadenza.plans.registry import SIG, Registry, signal, table

Q = Registry()


def smpte_sql(t: str, fps: str = "24") -> str:
    f = f"CAST(round_even({t} * {fps}, 0) AS BIGINT)"
    s = f"({f} // {fps})"
    return f"printf('%02d:%02d:%02d:%02d', {s} // 3600, {s} // 60 % 60, {s} % 60, {f} % {fps})"


def srt_sql(t: str) -> str:
    ms = f"CAST(round_even({t} * 1000, 0) AS BIGINT)"
    return f"printf('%02d:%02d:%02d,%03d', {ms} // 3600000, {ms} // 60000 % 60, {ms} // 1000 % 60, {ms} % 1000)"


@Q("timecode", f"WITH {SIG} SELECT film, i, {smpte_sql('score')} AS tc, {srt_sql('score')} AS srt, CAST(round_even(score * 24, 0) AS BIGINT) AS frame FROM sig")
def timecodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal(spark, sf_dir).select("film", "i", timecode.smpte("score", 24.0).alias("tc"), timecode.srt_time("score").alias("srt"), timecode.time_frame("score", 24.0).alias("frame"))


@Q("srt_lines", BOUNDS + f" SELECT film, shot_no, shot_no || chr(10) || {srt_sql('start')} || ' --> ' || {srt_sql('stop')} || chr(10) || 'Shot ' || shot_no || chr(10) || chr(10) AS entry FROM w WHERE stop > start")
def srt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.srt_entries(shots(spark, sf_dir), ["film"])


@Q("edl_lines", BOUNDS + f" SELECT film, shot_no, printf('%03d', shot_no) || '  AX       V     C        ' || {smpte_sql('start')} || ' ' || {smpte_sql('stop')} || ' ' || {smpte_sql('start')} || ' ' || {smpte_sql('stop')} || chr(10) AS entry FROM w WHERE stop IS NOT NULL")
def edl_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.edl_entries(shots(spark, sf_dir, skip_empty=False), ["film"], 24.0)


@Q("csv_rows", f"WITH {SIG}, c AS (SELECT film, i / 4.0 AS t FROM sig WHERE event_type = 'click') SELECT film, row_number() OVER (PARTITION BY film ORDER BY t) AS cut_index, printf('%.3f', t::DOUBLE) AS time_seconds, {smpte_sql('t')} AS timecode FROM c")
def csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cuts = signal(spark, sf_dir, "event_type").where("event_type = 'click'").select("film", (F.col("i") / 4).alias("t"))
    return sources.csv_rows(cuts, ["film"], "t", 24.0)


LINES = "l AS (SELECT l_orderkey AS film, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS line_no, CASE WHEN l_orderkey % 2 = 0 THEN 'shot ' || l_linenumber || ' ' ELSE '' END || l_partkey || ' ' || (l_partkey + 20) || ' a' || l_suppkey || ' 7 ' || CASE WHEN l_orderkey % 4 = 0 THEN '-9' ELSE 'x 3' END AS text FROM lineitem)"


@Q("parse_shots", f"""
WITH {LINES}, n AS (SELECT *, list_transform(regexp_extract_all(text, '-?[0-9]+'), lambda x: CAST(x AS BIGINT)) AS v FROM l),
k AS (SELECT *, row_number() OVER (PARTITION BY film ORDER BY line_no) AS rn FROM n WHERE len(v) >= 2), s AS (SELECT *, min(CASE WHEN rn <= 10 THEN CAST(len(v) >= 6 AS INT) END) OVER (PARTITION BY film) AS shift FROM k)
SELECT film, v[1 + shift] AS start_frame, v[2 + shift] AS end_frame FROM s""")  # fmt: skip
def parse_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("l_orderkey")
    head = F.when(key % 2 == 0, F.concat(F.lit("shot "), F.col("l_linenumber").cast("string"), F.lit(" "))).otherwise("")
    tail = F.when(key % 4 == 0, "-9").otherwise("x 3")
    text = F.concat(head, F.col("l_partkey").cast("string"), F.lit(" "), (F.col("l_partkey") + 20).cast("string"), F.lit(" a"), F.col("l_suppkey").cast("string"), F.lit(" 7 "), tail)
    lines = table(spark, sf_dir, "lineitem").select(key.alias("film"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("line_no"), text.alias("text"))
    return sources.shot_rows(lines, ["film"], "line_no", "text")


KEYWORDS = [("example", "tt1"), ("site", "tt2"), (".org", "tt3"), ("http", "tt4")]


@Q("keyword_map", "SELECT page_id, CASE WHEN contains(lower(url), 'example') THEN 'tt1' WHEN contains(lower(url), 'site') THEN 'tt2' WHEN contains(lower(url), '.org') THEN 'tt3' WHEN contains(lower(url), 'http') THEN 'tt4' END AS imdb FROM pages")
def keyword_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", sources.keyword_id(F.col("url"), KEYWORDS).alias("imdb"))


@Q("srt_parse", f"""
WITH {SIG}, t AS (SELECT film, string_agg({srt_sql('(i * 3.25)')} || ' --> 00:00:00,000', chr(10) ORDER BY i DESC) AS text FROM sig GROUP BY film),
s AS (SELECT film, list_sort(list_distinct(list_transform(regexp_extract_all(text, '([0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}},[0-9]{{3}}) -->', 1),
  lambda x: CAST(x[1:2] AS DOUBLE) * 3600 + CAST(x[4:5] AS DOUBLE) * 60 + CAST(x[7:8] AS DOUBLE) + CAST(x[10:12] AS DOUBLE) / 1000))) AS v FROM t)
SELECT film, round(unnest(v[2:]), 6) AS t FROM s""")  # fmt: skip
def srt_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamp = F.concat(timecode.srt_time(F.col("i") * 3.25), F.lit(" --> 00:00:00,000"))
    text = signal(spark, sf_dir).groupBy("film").agg(F.array_join(F.array_sort(F.collect_list(stamp)), "\n").alias("text"))
    return text.select("film", F.explode(sources.srt_cuts(F.col("text"))).alias("t")).select("film", F.round("t", 6).alias("t"))


@Q("showinfo_parse", f"WITH {SIG}, t AS (SELECT film, string_agg('[x] n:' || i || ' pts_time:' || CAST(score AS DECIMAL(10, 2)) || ' pos', chr(10)) AS text FROM sig GROUP BY film) SELECT film, CAST(unnest(regexp_extract_all(text, 'pts_time:([0-9.]+)', 1)) AS DOUBLE) AS t FROM t")
def showinfo_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("[x] n:"), F.col("i").cast("string"), F.lit(" pts_time:"), F.col("score").cast("decimal(10,2)").cast("string"), F.lit(" pos"))
    text = signal(spark, sf_dir).groupBy("film").agg(F.array_join(F.collect_list(line), "\n").alias("text"))
    return text.select("film", F.explode(sources.showinfo_times(F.col("text"))).alias("t"))


RUN = "r AS (SELECT event_id AS run_id, event_type <> 'error' AS decode_ok, CAST(user_id % 3 AS BIGINT) AS n_events, CASE WHEN user_id % 5 = 0 THEN NULL WHEN user_id % 7 = 0 THEN -1.0 ELSE value END AS probed, CAST(event_id % 4 AS BIGINT) * 100 AS n_frames, CASE WHEN event_id % 6 = 0 THEN 0.0 ELSE 25.0 END AS fps, CASE WHEN event_id % 9 = 0 THEN 0.0 ELSE value END AS elapsed, event_type FROM events)"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, user, event = table(spark, sf_dir, "events"), F.col("user_id"), F.col("event_id")
    return e.select(
        event.alias("run_id"), (F.col("event_type") != "error").alias("decode_ok"), (user % 3).alias("n_events"), F.when(user % 5 == 0, None).when(user % 7 == 0, -1.0).otherwise(F.col("value")).alias("probed"),
        (event % 4 * 100).alias("n_frames"), F.when(event % 6 == 0, 0.0).otherwise(25.0).alias("fps"), F.when(event % 9 == 0, 0.0).otherwise(F.col("value")).alias("elapsed"), "event_type",
    )


@Q("run_status", f"WITH {RUN} SELECT run_id, CASE WHEN decode_ok THEN 'complete' WHEN n_events > 0 THEN 'partial' ELSE 'failed' END AS status FROM r")
def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).select("run_id", timecode.run_status("decode_ok", "n_events").alias("status"))


@Q("duration_fallback", f"WITH {RUN} SELECT run_id, CASE WHEN probed > 0 THEN probed WHEN fps > 0 AND n_frames > 0 THEN n_frames / fps ELSE 0 END AS seconds, CASE WHEN probed > 0 THEN 'probed' WHEN fps > 0 AND n_frames > 0 THEN 'frames' ELSE 'none' END AS method FROM r")
def duration_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs(spark, sf_dir).select("run_id", timecode.duration(F.col("probed"), F.col("n_frames"), F.col("fps")).alias("d"))
    return found.select("run_id", "d.seconds", "d.method")


@Q("throughput", f"WITH {RUN} SELECT run_id, CASE WHEN elapsed > 0 THEN round(n_frames / elapsed, 6) END AS analysed_fps FROM r")
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).select("run_id", F.round(F.nanvl(timecode.throughput("n_frames", "elapsed"), F.lit(None).cast("double")), 6).alias("analysed_fps"))


@Q("sync_verdict", "SELECT event_id, CASE WHEN value / 100 > 0.75 THEN 'same' WHEN value / 100 > 0.4 THEN 'partial' ELSE 'none' END AS verdict FROM events")
def sync_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", timecode.sync_verdict(F.col("value") / 100).alias("verdict"))
