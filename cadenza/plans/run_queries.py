"""Queries of run diagnostics, whole documents, decoders' tables, sweeps and corpus scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadenza.operators import detectors, documents, runs, series, sweeps
from cadenza.plans.list_queries import CHAIN, HALF, KEEP, MERGE, MOST
from cadenza.plans.registry import SIG, Registry, marks, marks_sql, signal, table, thin_sql
from cadenza.sources import frames

Q = Registry()


def sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


KEYS = [*runs.DETECTOR_IDS, "own-detector"]
KEY_SQL = "[" + ", ".join(map(sql_text, KEYS)) + "]"


def case(column: str, pick: int | None = None, table_: dict | None = None, other: str = "NULL") -> str:
    pairs = (table_ or runs.DETECTOR_IDS).items()
    return f"CASE {column} " + " ".join(f"WHEN {sql_text(k)} THEN {sql_text(v if pick is None else v[pick])}" for k, v in pairs) + f" ELSE {other} END"


@Q("id_map", f"WITH k AS (SELECT event_id, {KEY_SQL}[event_id % {len(KEYS)} + 1] AS key FROM events) SELECT event_id, {case('key', 0, None, 'key')} AS detector_id, {case('key', 1)} AS backend FROM k")
def id_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.element_at(F.array(*[F.lit(k) for k in KEYS]), (F.col("event_id") % len(KEYS) + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", runs.detector_id(key).alias("d")).select("event_id", "d.*")


LOG = "CASE event_id % 4 WHEN 0 THEN '  \n ' WHEN 1 THEN ' [x] showinfo ' || repeat('y', CAST(event_id % 3000 AS INT)) WHEN 2 THEN repeat('z', CAST(event_id % 3000 AS INT)) || ' end' END"


def _log() -> Column:
    n = F.col("event_id")
    return F.when(n % 4 == 0, "  \n ").when(n % 4 == 1, F.concat(F.lit(" [x] showinfo "), F.repeat(F.lit("y"), (n % 3000).cast("int")))).when(n % 4 == 2, F.concat(F.repeat(F.lit("z"), (n % 3000).cast("int")), F.lit(" end")))


@Q("decode_notes", f"""
WITH e AS (SELECT event_id, CAST(event_id % 3 AS INT) AS code, {LOG} AS log FROM events), s AS (SELECT *, regexp_replace(coalesce(log, ''), '^\\s+|\\s+$', '', 'g') AS tail FROM e)
SELECT event_id, CASE WHEN code <> 0 THEN 'ffmpeg-scene exited ' || code || CASE WHEN contains(coalesce(log, ''), 'showinfo') THEN '' ELSE '; unusable decode:' || chr(10) || right(coalesce(log, ''), {runs.TAIL}) END END AS scene,
 CASE WHEN code <> 0 THEN 'transnet decode (ffmpeg) exited ' || code || CASE WHEN tail <> '' THEN '; stderr tail:' || chr(10) || right(tail, {runs.TAIL}) ELSE '' END END AS net FROM s""")  # fmt: skip
def decode_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 3).alias("code"), _log().alias("log"))
    return e.select("event_id", runs.filter_decode(F.col("code"), F.col("log"))["decode_detail"].alias("scene"), runs.net_decode(F.col("code"), F.col("log"))["decode_detail"].alias("net"))


@Q("duration_chains", """
WITH e AS (SELECT event_id, value, CASE event_id % 5 WHEN 0 THEN '12.5' WHEN 1 THEN 'N/A' WHEN 2 THEN '-1' WHEN 3 THEN 'inf' END AS container, CASE WHEN event_id % 3 = 0 THEN ['7.25', 'bad', '9.5'] WHEN event_id % 3 = 1 THEN ['0'] END AS streams,
 event_id % 4 * 100 AS n_frames, CASE WHEN event_id % 7 = 0 THEN 0.0 ELSE 25.0 END AS fps FROM events),
p AS (SELECT *, CASE WHEN event_id % 5 = 0 THEN 12.5 WHEN event_id % 3 = 0 THEN 9.5 END AS probed, CASE WHEN event_id % 5 = 0 THEN 'container' WHEN event_id % 3 = 0 THEN 'stream' END AS method FROM e)
SELECT event_id, probed, method, coalesce(CASE WHEN event_id % 6 = 0 THEN nullif(value, 0) END, nullif(n_frames, 0) / nullif(fps, 0), probed, CASE WHEN event_id % 2 = 0 THEN value + 5 END, 5.0) AS track FROM p""")  # fmt: skip
def duration_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    container = F.when(n % 5 == 0, "12.5").when(n % 5 == 1, "N/A").when(n % 5 == 2, "-1").when(n % 5 == 3, "inf")
    streams = F.when(n % 3 == 0, F.array(F.lit("7.25"), F.lit("bad"), F.lit("9.5"))).when(n % 3 == 1, F.array(F.lit("0")))
    e = table(spark, sf_dir, "events").select("event_id", "value", runs.probed_duration(container, streams).alias("p"), (n % 4 * 100).alias("n_frames"), F.when(n % 7 == 0, 0.0).otherwise(25.0).alias("fps"))
    track = runs.subtitle_duration(F.when(n % 6 == 0, F.col("value")), F.col("n_frames"), F.col("fps"), F.col("p.seconds"), F.when(n % 2 == 0, F.col("value")))
    return e.select("event_id", F.col("p.seconds").alias("probed"), "p.method", track.alias("track"))


@Q("v2_documents", f"""
WITH {SIG}, f AS (SELECT film, max(i) AS last, count(*) AS event_count, sum(i * 0.5) AS cuts, sum(CASE WHEN i % 2 = 0 THEN 1 ELSE 0 END) AS gradual, sum(CASE WHEN i % 9 = 5 THEN 1 ELSE 0 END) AS flagged, sum(score) AS strength,
  {KEY_SQL}[film % {len(KEYS)} + 1] AS key FROM sig GROUP BY film),
d AS (SELECT *, CASE WHEN film % 4 = 0 THEN 20.5 WHEN film % 3 = 0 THEN 9.5 WHEN film % 5 > 0 THEN film % 5 * 100 / 25.0 END AS duration, CASE WHEN film % 4 = 0 THEN '' WHEN film % 3 = 0 THEN {sql_text(runs.FROM_STREAM)} WHEN film % 5 > 0 THEN {sql_text(runs.FROM_FRAMES)} ELSE {sql_text(runs.NO_DURATION)} END AS said FROM f)
SELECT film, {case('key', 0, None, 'key')} AS detector_id, {case('key', 1)} AS backend, {case(case('key', 0), None, runs.MODELS)} AS model, CASE WHEN film % 6 = 0 THEN 'partial' ELSE 'complete' END AS status, round(duration, 3) AS duration,
 array_to_string(list_filter([CASE WHEN film % 6 = 0 THEN CASE WHEN film % 12 = 0 THEN 'torn' ELSE {sql_text(runs.DECODER_FAILED)} END END, CASE WHEN film % 7 = 0 THEN 'fixed gop' END, nullif(said, '')], lambda x: x IS NOT NULL), '|') AS warnings,
 CAST(event_count AS BIGINT) AS event_count, CAST(cuts AS DOUBLE) AS cuts, CAST(gradual AS BIGINT) AS gradual, CAST(flagged AS BIGINT) AS flagged, round(strength, 6) AS strength, 0.25 * gradual AS span, 0::BIGINT AS document_faults,
 (SELECT count(*) FROM sig WHERE sig.film = d.film AND sig.i * 0.5 > round(d.duration, 3)) AS late FROM d""")  # fmt: skip
def v2_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents from runs and events, read back field by field, with how many of their rules are broken."""
    film = F.col("film")
    s = signal(spark, sf_dir)
    told = s.select("film").distinct().select(
        "film", F.concat(F.lit("/films/"), film.cast("string")).alias("video"), F.element_at(F.array(*[F.lit(k) for k in KEYS]), (film % len(KEYS) + 1).cast("int")).alias("detector_key"), F.lit("display").alias("detector"), F.lit(25.0).alias("fps"),
        (film % 5 * 100).alias("n_frames"), F.when(film % 4 == 0, "20.5").otherwise("N/A").alias("container"), F.when(film % 3 == 0, F.array(F.lit("9.5"), F.lit("1"))).alias("streams"), (film * 1000).alias("size_bytes"), F.lit("2024-01-01T00:00:00Z").alias("mtime_utc"),
        (film % 6 != 0).alias("decode_ok"), F.when(film % 12 == 0, "torn").alias("decode_detail"), F.when(film % 7 == 0, "fixed gop").otherwise("").alias("warning"), F.struct(F.lit(0.4).alias("threshold")).alias("settings"),
    )
    gradual = F.col("i") % 2 == 0
    time = F.col("i") * 0.5
    events = s.select(
        "film", time.alias("time"), F.col("i").alias("frame"), F.when(gradual, "gradual").otherwise("hard").alias("kind"), F.when(gradual, F.greatest(time - 0.25, F.lit(0.0))).alias("span_start"), F.when(gradual, F.greatest(time - 0.25, F.lit(0.0)) + 0.25).alias("span_end"),
        F.col("score").alias("value"), F.lit("hsv_spike_ratio").alias("metric"), F.when(F.col("i") % 9 == 5, F.array(F.lit("strobe_suppressed"))).alias("flags"),
    )
    built = runs.documents_from_runs(told, events, ["film"], "cadenza", F.lit("2024-01-02T00:00:00Z"), check=False)
    d, get = F.parse_json("document"), F.try_variant_get
    text = lambda path: get(d, path, "string")
    facts = built.select(
        "film", text("$.run.detector_id").alias("detector_id"), text("$.run.backend").alias("backend"), text("$.run.model").alias("model"), text("$.analysis.status").alias("status"), get(d, "$.source.duration_seconds", "double").alias("duration"),
        F.array_join(get(d, "$.analysis.warnings", "array<string>"), "|").alias("warnings"), get(d, "$.analysis.event_count", "bigint").alias("event_count"), F.aggregate(get(d, "$.cuts", "array<double>"), F.lit(0.0), lambda a, x: a + x).alias("cuts"),
    )
    rows = documents.event_rows(built, ["film"], "document").groupBy("film").agg(
        F.count_if(F.col("kind") == "gradual").alias("gradual"), F.count_if(F.size("flags") > 0).alias("flagged"), F.round(F.sum("value"), 6).alias("strength"), F.coalesce(F.sum(F.col("span_end") - F.col("span_start")), F.lit(0.0)).alias("span")
    )
    faults = documents.document_violations(built, ["film"], "document").groupBy("film").agg(F.count(F.lit(1)).alias("document_faults"))
    late = documents.event_violations(built, ["film"], "document").groupBy("film").agg(F.count(F.lit(1)).alias("late"))
    return facts.join(rows, "film").join(faults, "film", "left").join(late, "film", "left").na.fill(0, ["document_faults", "late"])


@Q("event_round_trip", f"WITH {SIG} SELECT film, CAST(i AS INT) AS event_no, i * 0.5 AS time, CASE WHEN i % 2 = 0 THEN 'gradual' ELSE 'unknown' END AS kind, CASE WHEN i % 3 = 0 THEN score END AS value FROM sig")
def event_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON with omitted fields, read tolerantly."""
    i = F.col("i")
    one = F.struct((i * 0.5).alias("time"), F.when(i % 2 == 0, "gradual").alias("transition_kind"), F.when(i % 3 == 0, F.struct(F.col("score").alias("value"))).alias("confidence"))
    docs = signal(spark, sf_dir).groupBy("film").agg(F.array_sort(F.collect_list(one)).alias("cut_events")).select("film", F.to_json(F.struct("cut_events")).alias("doc"))
    return documents.event_rows(docs, ["film"], "doc").select("film", "event_no", "time", "kind", "value")


@Q("probe_info", """
SELECT event_id, CASE WHEN event_id % 6 = 5 THEN NULL ELSE CASE WHEN event_id % 2 = 0 THEN 24000 / 1001.0 ELSE 25.0 END END AS fps,
 CASE WHEN event_id % 6 = 5 THEN NULL WHEN event_id % 3 = 0 THEN 1000 + event_id ELSE CAST(round_even(CASE WHEN event_id % 4 = 1 THEN 0.0 ELSE 10.0 END * CASE WHEN event_id % 2 = 0 THEN 24000 / 1001.0 ELSE 25.0 END, 0) AS BIGINT) END AS n_frames,
 CASE WHEN event_id % 6 = 5 THEN NULL ELSE 640 END AS width FROM events""")  # fmt: skip
def probe_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    report = F.concat(F.lit('{"streams":[{"r_frame_rate":"'), F.when(n % 2 == 0, "24000/1001").otherwise("25/1"), F.lit('","width":640,"height":360'), F.when(n % 3 == 0, F.concat(F.lit(',"nb_frames":"'), (n + 1000).cast("string"), F.lit('"'))).otherwise(F.lit("")), F.when(n % 4 == 1, "").otherwise(',"duration":"10.0"'), F.lit("}]}"))
    e = table(spark, sf_dir, "events").select("event_id", frames.probe_info(F.when(n % 6 == 5, "{").otherwise(report)).alias("p"))
    return e.select("event_id", "p.fps", "p.n_frames", "p.width")


COLOUR = f"""WITH base AS (SELECT vec_id, label, embedding FROM embeddings), num AS (SELECT label AS film, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, embedding AS e FROM base),
px AS (SELECT film, frame, k, least(1.0, abs(CAST(e[3 * k + 1] AS DOUBLE))) AS r, least(1.0, abs(CAST(e[3 * k + 2] AS DOUBLE))) AS g, least(1.0, abs(CAST(e[3 * k + 3] AS DOUBLE))) AS b FROM num, range(0, 21) t(k)),
m AS (SELECT *, greatest(r, g, b) AS v, greatest(r, g, b) - least(r, g, b) AS span FROM px),
h AS (SELECT film, frame, k, v, span / (v + 1e-6) AS s, CASE WHEN span > 0 THEN (CASE WHEN v = r THEN (g - b) / (span + 1e-6) WHEN v = g THEN (b - r) / (span + 1e-6) + 2 ELSE (r - g) / (span + 1e-6) + 4 END) / 6 ELSE 0 END AS h0 FROM m),
n AS (SELECT film, frame, k, h0 - floor(h0) AS h, s, v FROM h),
d AS (SELECT film, frame, k, abs(h - lag(h) OVER w) AS dh, abs(s - lag(s) OVER w) AS ds, abs(v - lag(v) OVER w) AS dv FROM n WINDOW w AS (PARTITION BY film, k ORDER BY frame)),
c AS (SELECT film, frame, sum(0.45 * least(dh, 1 - dh) + 0.45 * ds + 0.1 * dv) / 63 AS score FROM d WHERE dh IS NOT NULL GROUP BY film, frame)"""  # fmt: skip


def _pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).cast("long")
    pixels = F.transform(F.slice("embedding", 1, 63), lambda x: F.least(F.lit(1.0), F.abs(x.cast("double"))))
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("film"), number.alias("frame"), pixels.alias("pixels"))


@Q("colour_scores", COLOUR + " SELECT film, frame, round(score, 9) AS score FROM c")
def colour_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = frames.colour_scores(_pictures(spark, sf_dir), ["film"], "frame", "pixels")
    return found.select("film", "frame", F.round("score", 9).alias("score"))


@Q("detect_colour", COLOUR + f""", i AS (SELECT film, frame - 1 AS i, score, min(frame - 1) OVER (PARTITION BY film) AS first FROM c),
a AS (SELECT x.film, x.i, any_value(x.score) AS score, any_value(x.first) AS first, median(y.score) AS med FROM i x LEFT JOIN i y ON y.film = x.film AND abs(y.i - x.i) BETWEEN 1 AND 15 GROUP BY x.film, x.i),
k AS (SELECT film, unnest({thin_sql('list(i ORDER BY i)', '4')}) AS i FROM a WHERE i > first AND score >= 0.01 AND score >= 1.2 * (coalesce(med, 0) + 1e-6) GROUP BY film)
SELECT film, round_even(i / 24.0, 4) AS time, i + 1 AS frame FROM k""")  # fmt: skip
def detect_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The colour detector from pixels, with a ratio that the tables reach."""
    return detectors.detect_colour(_pictures(spark, sf_dir), ["film"], ratio=1.2, floor=0.01).select("film", "time", "frame")


@Q("block_coverage", """
WITH f AS (SELECT o_orderkey AS film, o_custkey AS pts FROM orders), b AS (SELECT l_orderkey AS film, CAST(l_quantity AS BIGINT) * CAST(l_linenumber AS BIGINT) AS size, l_partkey % 3 - 1 AS source FROM lineitem),
s AS (SELECT film, sum(CASE WHEN source < 0 THEN size END) AS p, sum(CASE WHEN source > 0 THEN size END) AS n FROM b GROUP BY film)
SELECT film, coalesce(p, 0) / 1000.0 AS fwd, coalesce(n, 0) / 1000.0 AS bwd, coalesce(p, 0) / 1000.0 + coalesce(n, 0) / 1000.0 AS cov FROM f LEFT JOIN s USING (film) WHERE film % 5 <> 0""")  # fmt: skip
def block_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    f = table(spark, sf_dir, "orders").select(key.alias("film"), F.lit(0).alias("frame"), F.when(key % 5 != 0, F.col("o_custkey")).alias("pts"))
    b = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("film"), F.lit(0).alias("frame"), F.col("l_quantity").alias("w"), F.col("l_linenumber").alias("h"), (F.col("l_partkey") % 3 - 1).alias("source"))
    return frames.block_coverage(f, b, ["film"], 1000.0).select("film", "fwd", "bwd", "cov")


CONTENT = f"WITH {SIG}, w AS (SELECT film, i, score, (lag(score, 1) OVER o + lag(score, 2) OVER o + lead(score, 1) OVER o + lead(score, 2) OVER o) / 4 AS mean FROM sig WINDOW o AS (PARTITION BY film ORDER BY i))"


@Q("content_cuts", CONTENT + f", k AS (SELECT film, unnest({thin_sql('list_prepend(0::BIGINT, list(i ORDER BY i))', '15')}[2:]) AS i FROM w WHERE score >= 50 GROUP BY film) SELECT film, round_even(i / 24.0, 4) AS time FROM k")
def content_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signal(spark, sf_dir).select("film", F.col("i").alias("frame"), F.col("score").alias("change"))
    return detectors.detect_content(s, ["film"], threshold=50.0).select("film", "time")


@Q("ratio_cuts", CONTENT + f", k AS (SELECT film, unnest({thin_sql('list_prepend(0::BIGINT, list(i ORDER BY i))', '15')}[2:]) AS i FROM w WHERE mean IS NOT NULL AND score >= 15 AND least(score / mean, 255) >= 1.5 GROUP BY film) SELECT film, i FROM k")
def ratio_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.ratio_cuts(signal(spark, sf_dir), ["film"], "i", "score", 1.5).select("film", "i")


@Q("reference_cuts", "WITH s AS (SELECT l_orderkey AS film, l_linenumber AS f, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem), i AS (SELECT o_orderkey AS film, o_custkey % 3 * 12.5 AS fps FROM orders WHERE o_orderkey % 4 <> 0) SELECT film, round_even(f / coalesce(nullif(fps, 0), 24.0), 4) AS t FROM s LEFT JOIN i USING (film) WHERE n > 1")
def reference_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    shots = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("film"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("shot_no"), F.col("l_linenumber").alias("start_frame"))
    info = table(spark, sf_dir, "orders").where("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("film"), (F.col("o_custkey") % 3 * 12.5).alias("fps"))
    return frames.reference_cuts(shots, info, ["film"])


@Q("loaded_cuts", "WITH l AS (SELECT user_id AS path, list(round(value, 3) ORDER BY round(value, 3)) AS cuts FROM events WHERE user_id % 3 <> 0 GROUP BY user_id), s AS (SELECT DISTINCT user_id AS film FROM events) SELECT film, CASE WHEN film % 5 <> 0 THEN array_to_string(list_transform(cuts, lambda x: printf('%.3f', x)), ',') END AS cuts FROM s LEFT JOIN l ON l.path = s.film")
def loaded_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    lists = e.where("user_id % 3 <> 0").groupBy(F.col("user_id").alias("path")).agg(F.collect_list(F.round("value", 3)).alias("cuts"))
    specs = e.select(F.col("user_id").alias("film"), F.col("user_id").alias("path"), F.when(F.col("user_id") % 5 == 0, "none").otherwise("human").alias("kind")).distinct()
    return frames.load_cuts(specs, lists).select("film", F.array_join(F.transform("cuts", lambda x: F.format_string("%.3f", x)), ",").alias("cuts"))


@Q("region_intervals", f"WITH {SIG}, r AS (SELECT DISTINCT film, 1.0 AS lo, 900.0 AS hi FROM sig), b AS (SELECT film, lo AS s, 0 AS side FROM r UNION ALL SELECT film, 1 + i % 40, 1 FROM sig UNION ALL SELECT film, hi, 2 FROM r), w AS (SELECT film, row_number() OVER o AS shot_no, s AS start, lead(s) OVER o AS stop FROM b WINDOW o AS (PARTITION BY film ORDER BY side, s)) SELECT film, shot_no, CAST(start AS DOUBLE) AS start, CAST(stop AS DOUBLE) AS \"end\" FROM w WHERE stop IS NOT NULL")
def region_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signal(spark, sf_dir)
    regions = s.select("film", F.lit(1.0).alias("lo"), F.lit(900.0).alias("hi")).distinct()
    return frames.region_intervals(s.select("film", (1 + F.col("i") % 40).alias("t")), regions, ["film"], "t")


def _clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.least(F.col("n_chars") / 5000, F.lit(1.0)).alias("p"))
    return table(spark, sf_dir, "labels").select("doc_id", "toxic", "quality").join(d, "doc_id")


@Q("feature_stats", "WITH c AS (SELECT l.toxic = 1 AS gt, least(d.n_chars / 5000.0, 1.0) AS p, l.quality FROM labels l JOIN documents d USING (doc_id)), u AS (SELECT gt, 'p' AS feature, p AS v FROM c UNION ALL SELECT gt, 'quality', quality FROM c) SELECT feature, gt, round(avg(v), 9) AS mean, CAST(min(v) AS DOUBLE) AS low, CAST(max(v) AS DOUBLE) AS high FROM u GROUP BY feature, gt")
def feature_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sweeps.feature_stats(_clips(spark, sf_dir).withColumn("gt", F.col("toxic") == 1), "gt", ["p", "quality"])
    return found.withColumn("mean", F.round("mean", 9))


GRID = ((10.0, 40.0), (60.0, 90.0, 1000.0), (0, 6, 30))
_COMBOS = ", ".join(f"({n}, {a!r}, {b!r}, {c})" for n, (a, b, c) in enumerate((a, b, c) for a in GRID[0] for b in GRID[1] for c in GRID[2]))
GRID_SQL = f"""
WITH {SIG}, g(combo, least_, below, spacing) AS (VALUES {_COMBOS}), a AS (SELECT combo, spacing, film, i AS t FROM sig, g WHERE score >= least_ AND score < below),
n AS (SELECT *, count(*) OVER (PARTITION BY combo, film ORDER BY t RANGE BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS near FROM a WHERE spacing > 0),
d AS (SELECT *, near > 4 AS dense, t - lag(t) OVER (PARTITION BY combo, film ORDER BY t) AS since FROM n),
c AS (SELECT *, sum(CASE WHEN since IS NULL OR (NOT dense AND since >= 4) THEN 1 ELSE 0 END) OVER (PARTITION BY combo, film ORDER BY t ROWS UNBOUNDED PRECEDING) AS chain FROM d),
r AS (SELECT *, max(dense) OVER (PARTITION BY combo, film, chain ORDER BY t ROWS UNBOUNDED PRECEDING) AS inside FROM c),
k AS (SELECT combo, film, t FROM a WHERE spacing = 0 UNION ALL SELECT combo, film, t FROM r WHERE NOT inside
 UNION ALL SELECT combo, film, unnest({thin_sql('list(t ORDER BY t)', '6')}) FROM r WHERE inside AND spacing = 6 GROUP BY combo, film, chain UNION ALL SELECT combo, film, unnest({thin_sql('list(t ORDER BY t)', '30')}) FROM r WHERE inside AND spacing = 30 GROUP BY combo, film, chain),
truth AS (SELECT film, i AS t FROM sig WHERE event_type = 'click'),
s AS (SELECT g.combo, (SELECT count(*) FROM k WHERE k.combo = g.combo) AS n_pred, (SELECT count(*) FROM k JOIN truth USING (film, t) WHERE k.combo = g.combo) AS tp, (SELECT count(*) FROM truth) AS n_truth FROM g),
q AS (SELECT *, CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 1.0 END AS p, CASE WHEN n_truth > 0 THEN tp / n_truth ELSE 1.0 END AS rc FROM s)
SELECT combo, tp, n_pred, round_even(p, 3) AS precision, round_even(rc, 3) AS recall, round_even(CASE WHEN p + rc > 0 THEN 2 * p * rc / (p + rc) ELSE 0.0 END, 3) AS f1 FROM q"""  # fmt: skip


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signal(spark, sf_dir, "event_type").withColumnRenamed("i", "t")
    return sweeps.grid_scores(s, s.where("event_type = 'click'"), ["film"], "t", 0, *GRID, "score", "score", 4, 4, 4)


@Q("grid_scores", GRID_SQL)
def grid_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir).select("combo", "tp", "n_pred", "precision", "recall", "f1")


@Q("grid_best", f"SELECT combo, f1 FROM ({GRID_SQL}) ORDER BY f1 DESC, combo LIMIT 1")
def grid_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweeps.grid_best(_grid(spark, sf_dir)).select("combo", "f1")


@Q("track_length", f"WITH {marks_sql('p', 'click')}, {marks_sql('g', 'view')} SELECT film, max(t) + 5 AS duration FROM (SELECT * FROM p UNION ALL SELECT * FROM g) GROUP BY film")
def track_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweeps.track_length(marks(spark, sf_dir, "click"), marks(spark, sf_dir, "view"), ["film"], "t")


_SIDE = "WITH g AS (SELECT user_id AS film, event_id AS t FROM events WHERE event_type = 'view'), a AS (SELECT user_id AS film, event_id AS t FROM events WHERE event_type IN ('view', 'click')), b AS (SELECT user_id AS film, event_id AS t FROM events WHERE event_type = 'view' AND event_id % 2 = 0)"


@Q("side_by_side", _SIDE + """, n AS (SELECT film, count(*) AS n_truth FROM g GROUP BY film), x AS (SELECT film, count(*) AS n FROM a GROUP BY film), y AS (SELECT film, count(*) AS n FROM b GROUP BY film)
SELECT film, n_truth, x.n AS own_n, round_even(2 * (n_truth / x.n) * 1.0 / (n_truth / x.n + 1.0), 3) AS own_f1, y.n AS cached_n, round_even(2 * (y.n / n_truth) / (y.n / n_truth + 1.0), 3) AS cached_f1 FROM n LEFT JOIN x USING (film) LEFT JOIN y USING (film)""")  # fmt: skip
def side_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("film"), F.col("event_id").alias("t"), "event_type")
    truth = e.where("event_type = 'view'").select("film", "t")
    lists = {"own": e.where("event_type IN ('view', 'click')").select("film", "t"), "cached": truth.where("t % 2 = 0")}
    return sweeps.side_by_side(lists, truth, ["film"], "t", 0).select("film", "n_truth", "own_n", "own_f1", "cached_n", "cached_f1")


@Q("stream_scaling", "WITH t AS (SELECT o_custkey % 8 + 1 AS k, max(o_orderkey) AS n, 2.0 + count(*) / 100 AS wall FROM orders GROUP BY 1), r AS (SELECT k, k * n / wall AS rate FROM t) SELECT k, round(rate, 6) AS aggregate_fps, round(rate / 25, 6) AS streams, round(rate / (SELECT rate FROM r ORDER BY k LIMIT 1), 6) AS scaling FROM r")
def stream_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 8 + 1).alias("k")).agg(F.max("o_orderkey").alias("n"), (2.0 + F.count(F.lit(1)) / 100).alias("wall")).withColumn("fps", F.lit(25.0))
    return sweeps.scaling(t, "k", "n", "wall", "fps").select("k", *[F.round(c, 6).alias(c) for c in ("aggregate_fps", "streams", "scaling")])


@Q("three_way_partition", CHAIN.replace(" FROM events)", " FROM events WHERE value < 60)") + f", k AS (SELECT film, t FROM r WHERE NOT in_region UNION ALL SELECT film, unnest({thin_sql('list(t ORDER BY t)', str(KEEP))}) AS t FROM r WHERE in_region GROUP BY film, chain), a AS (SELECT user_id AS film, epoch_us(ts) AS t FROM events) SELECT film, t, CASE WHEN (film, t) IN (SELECT (film, t) FROM k) THEN 'KEEP' WHEN (film, t) IN (SELECT (film, t) FROM e) THEN 'burst' ELSE 'flash' END AS verdict FROM a")
def three_way_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps by what becomes of them: alike on both sides, thinned as part of a burst, or kept."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("film"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "value")
    return sweeps.hybrid_filter(e, ["film"], "t", F.col("value"), 60.0, HALF, MOST, MERGE, KEEP)


@Q("corpus_scores")
def corpus_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every film with an id and both lists: aligned, remapped and scored; the iteration is beyond SQL and tested on known shifts."""
    s = signal(spark, sf_dir, "event_type").where("event_type IN ('click', 'view')")
    own = s.select("film", (F.col("i") * 7.3 + F.col("score") % 5).alias("t"))
    ref = own.where("cast(t as long) % 10 <> 0").select("film", ((F.col("t") - 4.0) * (24.0 / 25.0)).alias("t"))
    films = s.select(F.when(F.col("film") % 6 != 0, F.col("film")).alias("film"))
    return sweeps.corpus_scores(films, ref, own, ["film"])
