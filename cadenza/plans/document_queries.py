"""Queries of document assembly and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.operators import documents
from cadenza.plans.registry import SIG, Registry, signal

Q = Registry()

# events with planted faults, as JSON text made alike on both sides
EVENTS_SQL = f"""
WITH {SIG}, x AS (SELECT film, i, '{{"time":' || CASE WHEN i % 11 = 3 THEN '-1' WHEN i % 13 = 5 THEN 'true' WHEN i % 17 = 6 THEN '1' ELSE i || '.5' END
 || ',"transition_kind":"' || CASE WHEN i % 7 = 2 THEN 'wipe' WHEN i % 2 = 0 THEN 'gradual' ELSE 'hard' END || '"'
 || CASE WHEN i % 5 = 0 THEN ',"frame":' || CASE WHEN i % 10 = 0 THEN '-4' ELSE CAST(i AS VARCHAR) END ELSE '' END
 || CASE WHEN i % 6 = 1 THEN ',"span":{{"start":0.5,"end":900.5}}' WHEN i % 6 = 4 THEN ',"span":{{"start":0.5,"end":1.5}}' ELSE '' END
 || CASE WHEN i % 9 = 4 THEN ',"flags":["odd"]' WHEN i % 9 = 5 THEN ',"flags":["strobe_suppressed"]' ELSE '' END || '}}' AS e FROM sig)"""


def event_text():
    i = F.col("i")
    s = i.cast("string")
    return F.concat(
        F.lit('{"time":'), F.when(i % 11 == 3, "-1").when(i % 13 == 5, "true").when(i % 17 == 6, "1").otherwise(F.concat(s, F.lit(".5"))),
        F.lit(',"transition_kind":"'), F.when(i % 7 == 2, "wipe").when(i % 2 == 0, "gradual").otherwise("hard"), F.lit('"'),
        F.when(i % 5 == 0, F.concat(F.lit(',"frame":'), F.when(i % 10 == 0, "-4").otherwise(s))).otherwise(""),
        F.when(i % 6 == 1, ',"span":{"start":0.5,"end":900.5}').when(i % 6 == 4, ',"span":{"start":0.5,"end":1.5}').otherwise(""),
        F.when(i % 9 == 4, ',"flags":["odd"]').when(i % 9 == 5, ',"flags":["strobe_suppressed"]').otherwise(""), F.lit("}"),
    )


T = "CASE WHEN i % 11 = 3 THEN -1.0 WHEN i % 13 = 5 THEN NULL WHEN i % 17 = 6 THEN 1.0 ELSE i + 0.5 END"


@Q("event_rules", f"""
WITH {SIG}, t AS (SELECT film, i, {T} AS t, i % 7 = 2 AS wipe, i % 2 = 0 AND i % 7 <> 2 AS gradual FROM sig), w AS (SELECT *, lag(t) OVER (PARTITION BY film ORDER BY i) AS b FROM t),
r AS (SELECT film, i, unnest([CASE WHEN t IS NULL OR t < 0 THEN 'time' END, CASE WHEN wipe THEN 'kind' END, CASE WHEN t < b THEN 'order' WHEN t = b THEN 'duplicate' END, CASE WHEN i % 10 = 0 THEN 'frame' END,
 CASE WHEN (i % 6 = 1 AND NOT coalesce(gradual AND t BETWEEN 0.5 AND 900.5, false)) OR (i % 6 = 4 AND NOT coalesce(gradual AND t BETWEEN 0.5 AND 1.5, false)) THEN 'span' END, CASE WHEN i % 9 = 4 THEN 'flags' END,
 CASE WHEN NOT coalesce(t BETWEEN 0 AND 50, false) THEN 'coverage' END]) AS rule FROM w)
SELECT film, CAST(i AS INT) AS event_no, rule FROM r WHERE rule IS NOT NULL""")  # fmt: skip
def event_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = signal(spark, sf_dir).withColumn("e", event_text()).groupBy("film").agg(F.array_sort(F.collect_list(F.struct("i", "e"))).alias("es"))
    text = F.concat(F.lit('{"analysis":{"coverage":[{"start":0,"end":50}]},"cut_events":['), F.array_join(F.transform("es", lambda x: x["e"]), ","), F.lit("]}"))
    return documents.event_violations(parts.select("film", text.alias("doc")), ["film"], "doc")


@Q("document_rules", """
SELECT event_id, unnest(list_filter([CASE WHEN event_id % 3 = 1 THEN 'format' END, CASE WHEN event_id % 4 = 1 THEN 'version' END, CASE WHEN event_id % 5 = 1 THEN 'fps' END,
 CASE WHEN event_id % 6 = 1 THEN 'video' END, CASE WHEN event_id % 7 = 1 THEN 'status' END, CASE WHEN event_id % 8 = 1 THEN 'event_count' END, CASE WHEN event_id % 9 = 1 THEN 'cuts' END, CASE WHEN event_id % 10 = 1 THEN 'run_optional' END, CASE WHEN event_id % 10 = 1 THEN 'null' END], lambda x: x IS NOT NULL)) AS rule FROM events""")  # fmt: skip
def document_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    text = F.concat(
        F.lit('{"format":"'), F.when(n % 3 == 1, "other").otherwise(documents.FORMAT), F.lit('","schema_version":'), F.when(n % 4 == 1, "true").otherwise("2"),
        F.lit(',"fps":'), F.when(n % 5 == 1, "0").otherwise("23.976"), F.lit(',"detector":"d","video":"'), F.when(n % 6 == 1, "").otherwise("v"),
        F.lit('","source":{"path":"p","size_bytes":1,"mtime_utc":"t"},"run":{"detector_id":"x","settings":{}'), F.when(n % 10 == 1, ',"backend":null').otherwise(""), F.lit('},"analysis":{"status":"'), F.when(n % 7 == 1, "done").otherwise("complete"), F.lit('","warnings":[],"event_count":'), F.when(n % 8 == 1, "3").otherwise("2"),
        F.lit('},"cut_events":[{"time":1.5},{"time":2.5}],"cuts":[1.5,'), F.when(n % 9 == 1, "2.4").otherwise("2.5"), F.lit("]}"),
    )
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", text.alias("doc"))
    return documents.document_violations(e, ["event_id"], "doc")


@Q("cache_rules", """
SELECT event_id, CASE WHEN event_id % 5 IN (0, 1) THEN value > 0 ELSE false END AS accepted, CASE WHEN event_id % 5 IN (0, 1) AND value > 0 THEN value END AS fps FROM events""")  # fmt: skip
def cache_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, v = F.col("event_id") % 5, F.col("value").cast("decimal(12,2)").cast("string")
    text = F.concat(F.when(n == 0, '{"format":"score-cache",').when(n == 2, '{"format":"cut-events",').when(n == 3, '{"extra":1,').otherwise("{"), F.lit('"cuts":[1.0],"fps":'), F.when(n == 4, "true").otherwise(v), F.lit("}"))
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", text.alias("doc"))
    return documents.score_cache(e, ["event_id"], "doc").select("event_id", "accepted", "fps")


@Q("document_build", f"WITH {SIG} SELECT film, count(*) AS event_count, round(sum(i / 4.0), 6) AS sum_cuts FROM sig GROUP BY film")
def document_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents are built and read back; the oracle checks their derived fields."""
    s = signal(spark, sf_dir)
    runs = s.groupBy("film").agg((F.max("i") / 4).alias("duration")).select("film", F.concat(F.lit("film-"), F.col("film").cast("string")).alias("video"), F.lit("hsv").alias("detector"), F.lit(24.0).alias("fps"), "duration", F.lit("complete").alias("status"))
    events = s.select("film", (F.col("i") / 4).alias("time"), "i", F.lit("hard").alias("kind"), F.col("score").alias("value"), F.lit("hsv_spike").alias("metric")).withColumnRenamed("i", "frame")
    d = documents.build_documents(runs, events, ["film"]).select("film", F.parse_json("document").alias("d"))
    cuts = F.variant_get("d", "$.cuts", "array<double>")
    return d.select("film", F.variant_get("d", "$.analysis.event_count", "bigint").alias("event_count"), F.round(F.aggregate(cuts, F.lit(0.0), lambda a, x: a + x), 6).alias("sum_cuts"))
