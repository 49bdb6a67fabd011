"""Queries of the series detectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions import timecode
from cadenza.operators import folds, series
from cadenza.plans.registry import HOUR, SIG, Registry, marks, marks_sql, signal, table, thin_sql

Q = Registry()

MEDIAN = "coalesce(median(score) OVER (PARTITION BY film ORDER BY i ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING EXCLUDE CURRENT ROW), 0)"
SPIKES = f"WITH {SIG}, m AS (SELECT *, {MEDIAN} AS med FROM sig), acc AS (SELECT film, i, score, score / (med + 1e-6) AS spike FROM m WHERE i >= 1 AND score >= 0.045 AND score >= 3.0 * (med + 1e-6))"


@Q("frame_diff", """
WITH f AS (SELECT label, vec_id, embedding AS e, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings)
SELECT label, vec_id, round(list_sum(list_transform(range(1, len(e) + 1), lambda k: abs(CAST(e[k] AS DOUBLE) - CAST(b[k] AS DOUBLE)))) / len(e), 9) AS score
FROM f WHERE b IS NOT NULL""")  # fmt: skip
def frame_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = series.frame_difference(table(spark, sf_dir, "embeddings"), ["label"], "vec_id", "embedding")
    return found.select("label", "vec_id", F.round("score", 9).alias("score"))


@Q("adaptive_spike", SPIKES + " SELECT film, i, score, round(spike, 9) AS spike FROM acc")
def adaptive_spike(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.adaptive_spikes(signal(spark, sf_dir), ["film"], "i", "score").select("film", "i", "score", F.round("spike", 9).alias("spike"))


@Q("spike_nms", SPIKES + f", k AS (SELECT film, unnest({thin_sql('list(i ORDER BY i)', '4')}) AS i FROM acc GROUP BY film) SELECT film, i, score, round(spike, 9) AS spike FROM k JOIN acc USING (film, i)")
def spike_nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.spikes(signal(spark, sf_dir), ["film"], "i", "score").select("film", "i", "score", F.round("spike", 9).alias("spike"))


PEAKS = f"WITH {SIG}, n AS (SELECT *, lag(score) OVER w AS b, lead(score) OVER w AS a FROM sig WINDOW w AS (PARTITION BY film ORDER BY i)), p AS (SELECT film, i, score FROM n WHERE score >= 40 AND score >= b AND score > a)"


@Q("local_maxima", PEAKS + f", k AS (SELECT film, unnest({thin_sql('list(i ORDER BY i)', '3')}) AS i FROM p GROUP BY film) SELECT film, i, score FROM k JOIN p USING (film, i)")
def local_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.local_maxima(signal(spark, sf_dir), ["film"], "i", "score", 40.0, 3).select("film", "i", "score")


@Q("peak_prob", f"WITH {SIG} SELECT film, i, max(score) OVER (PARTITION BY film ORDER BY i ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS peak FROM sig")
def peak_prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.trailing_peak(signal(spark, sf_dir), ["film"], "i", "score").select("film", "i", "peak")


@Q("gradual_span", f"""
WITH {SIG}, r AS (SELECT *, sum(CASE WHEN score < 20 THEN 1 ELSE 0 END) OVER (PARTITION BY film ORDER BY i) AS run FROM sig), g AS (SELECT * FROM r WHERE score >= 20)
SELECT film, i, min(i) OVER (PARTITION BY film, run) AS span_lo, max(i) OVER (PARTITION BY film, run) AS span_hi FROM g""")  # fmt: skip
def gradual_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.spans(signal(spark, sf_dir), ["film"], "i", "score", 20.0).select("film", "i", "span_lo", "span_hi")


@Q("score_runs", f"""
WITH {SIG}, r AS (SELECT *, sum(CASE WHEN score >= 30 THEN 0 ELSE 1 END) OVER (PARTITION BY film ORDER BY i) AS run FROM sig)
SELECT film, min(i) AS run_start, max(i) AS run_end, count(*) AS run_length FROM r WHERE score >= 30 GROUP BY film, run""")  # fmt: skip
def score_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.runs(signal(spark, sf_dir), ["film"], "i", F.col("score") >= 30)


@Q("threshold_scenes", f"WITH {SIG}, w AS (SELECT *, lag(score) OVER (PARTITION BY film ORDER BY i) AS b FROM sig) SELECT film, i FROM w WHERE b > 60 AND NOT score > 60")
def threshold_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.scene_starts(signal(spark, sf_dir), ["film"], "i", "score", 60.0).select("film", "i")


EXCLUDE = f"WITH {marks_sql('c', 'click')}, {marks_sql('v', 'view')}, far AS (SELECT DISTINCT c.film, c.t FROM c WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.film = c.film AND abs(v.t - c.t) <= {12 * HOUR}))"


@Q("gradual_exclusion", EXCLUDE + f" SELECT film, unnest({thin_sql('list(t ORDER BY t)', str(12 * HOUR), '>')}) AS t FROM far GROUP BY film")
def gradual_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.exclude_growing(marks(spark, sf_dir, "click").distinct(), marks(spark, sf_dir, "view"), ["film"], "t", 12 * HOUR)


@Q("sharp_exclusion", EXCLUDE + " SELECT film, t FROM far")
def sharp_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.exclude_near(marks(spark, sf_dir, "click").distinct(), marks(spark, sf_dir, "view"), ["film"], "t", 12 * HOUR)


KINDS = "CASE event_type WHEN 'signup' THEN 'I' WHEN 'error' THEN 'B' ELSE 'P' END"
MV = f"WITH {SIG}, c AS (SELECT film, i, i / 24.0 AS pts, {KINDS} AS kind, least(score / 100, 1.0) AS cov, (score % 10) / 10 * least(score / 100, 1.0) AS bwd FROM sig)"
MV += ", s AS (SELECT *, CASE WHEN cov > 0 THEN bwd / greatest(cov, 1e-9) ELSE 0.5 END AS share FROM c)"
MV += ", pb AS (SELECT film, i, quantile_cont(cov, 0.5) OVER (PARTITION BY film ORDER BY i ROWS BETWEEN 25 PRECEDING AND 24 FOLLOWING) AS baseline FROM s WHERE kind = 'P')"
MV += ", b AS (SELECT s.*, pb.baseline FROM s LEFT JOIN pb USING (film, i))"
MV += ", o AS (SELECT *, CASE WHEN kind = 'B' AND cov > 0.05 THEN 2 * abs(share - 0.5) WHEN kind = 'P' AND baseline > 0 AND cov < baseline THEN 1 - cov / baseline ELSE 0 END AS own FROM b)"
MV += ", k AS (SELECT *, max(own) OVER (PARTITION BY film ORDER BY i ROWS BETWEEN 2 PRECEDING AND 3 FOLLOWING) AS corroboration FROM o)"
MV += ", g AS (SELECT film, pts, i, corroboration, pts - lag(pts) OVER (PARTITION BY film ORDER BY pts) AS gap FROM k WHERE kind = 'I')"
MV += ", p AS (SELECT film, count(*) AS n_intra, coalesce(nullif(quantile_cont(gap, 0.99), 0), max(gap)) AS keyint, quantile_cont(gap, 0.5) AS med FROM g GROUP BY film HAVING count(*) >= 3)"


def codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codec records: kind, coverage and backward coverage per step."""
    e = signal(spark, sf_dir, "event_type")
    cov = F.least(F.col("score") / 100, F.lit(1.0))
    kind = F.when(F.col("event_type") == "signup", "I").when(F.col("event_type") == "error", "B").otherwise("P")
    out = e.select("film", "i", (F.col("i") / F.lit(24.0)).alias("pts"), kind.alias("kind"), cov.alias("cov"), (F.col("score") % 10 / 10 * cov).alias("bwd"))
    return out.withColumn("share", timecode.backward_share("cov", "bwd"))


@Q("rolling_median_p", MV + " SELECT film, i, round(baseline, 9) AS baseline FROM pb")
def rolling_median_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = series.inter_baseline(codec(spark, sf_dir), ["film"], "i", "cov", F.col("kind") == "P").where("kind = 'P'")
    return found.select("film", "i", F.round("baseline", 9).alias("baseline"))


def corroborated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.corroboration(series.inter_baseline(codec(spark, sf_dir), ["film"], "i", "cov", F.col("kind") == "P"), ["film"], "i")


@Q("mv_corrob", MV + " SELECT film, i, round(corroboration, 9) AS corroboration FROM k")
def mv_corrob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corroborated(spark, sf_dir).select("film", "i", F.round("corroboration", 9).alias("corroboration"))


@Q("gop_regularity", MV + " SELECT film, p.n_intra, round(keyint, 9) AS keyint, round(avg(CASE WHEN abs(gap - med) < 0.05 THEN 1.0 ELSE 0.0 END), 9) AS regularity, avg(CASE WHEN abs(gap - med) < 0.05 THEN 1.0 ELSE 0.0 END) > 0.9 AS fixed_gop FROM g JOIN p USING (film) WHERE gap IS NOT NULL GROUP BY ALL")
def gop_regularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = series.gop_profile(codec(spark, sf_dir).where("kind = 'I'"), ["film"], "pts")
    return found.select("film", "n_intra", F.round("keyint", 9).alias("keyint"), F.round("regularity", 9).alias("regularity"), (F.col("regularity") > 0.9).alias("fixed_gop"))


EARLY = "greatest(0.0, least(1.0, 1 - coalesce(gap, keyint) / keyint))"


@Q("mv_earliness", MV + f" SELECT film, i, round({EARLY}, 9) AS earliness FROM g JOIN p USING (film)")
def mv_earliness(spark: SparkSession, sf_dir: str) -> DataFrame:
    intra = codec(spark, sf_dir).where("kind = 'I'")
    return series.earliness(intra, series.gop_profile(intra, ["film"], "pts"), ["film"], "pts").select("film", "i", F.round("earliness", 9).alias("earliness"))


@Q("mv_score", MV + f" SELECT film, i, round(corroboration + 0.5 * {EARLY}, 6) AS score FROM g JOIN p USING (film) WHERE corroboration + 0.5 * {EARLY} >= 0.3")
def mv_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    intra = corroborated(spark, sf_dir).where("kind = 'I'")
    found = series.earliness(intra, series.gop_profile(intra, ["film"], "pts"), ["film"], "pts")
    score = F.col("corroboration") + 0.5 * F.col("earliness")
    return found.where(score >= 0.3).select("film", "i", F.round(score, 6).alias("score"))


@Q("clip_peak", f"WITH {SIG} SELECT film, max(score) AS max_score, max(i) AS max_i FROM sig GROUP BY film")
def clip_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.clip_peak(signal(spark, sf_dir), ["film"], ["score", "i"])


@Q("self_normalised", f"WITH {SIG} SELECT film, i, round(score / (median(score) OVER (PARTITION BY film) + 1e-6), 9) AS normalised FROM sig")
def self_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.self_normalised(signal(spark, sf_dir), ["film"], "score").select("film", "i", F.round("normalised", 9).alias("normalised"))


HSV = """
WITH c AS (SELECT vec_id, abs(embedding[1]) / (abs(embedding[1]) + 1) AS r, abs(embedding[2]) / (abs(embedding[2]) + 1) AS g, abs(embedding[3]) / (abs(embedding[3]) + 1) AS b FROM embeddings),
m AS (SELECT vec_id, CAST(r AS DOUBLE) AS r, CAST(g AS DOUBLE) AS g, CAST(b AS DOUBLE) AS b FROM c), x AS (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM m),
h AS (SELECT *, CASE WHEN hi = r THEN (g - b) / (hi - lo + 1e-6) WHEN hi = g THEN (b - r) / (hi - lo + 1e-6) + 2 ELSE (r - g) / (hi - lo + 1e-6) + 4 END / 6 AS u FROM x)
SELECT vec_id, round(CASE WHEN hi > lo THEN u - floor(u) ELSE 0 END, 6) AS h, round((hi - lo) / (hi + 1e-6), 6) AS s, round(hi, 6) AS v FROM h"""


@Q("rgb_to_hsv", HSV)
def rgb_to_hsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = lambda k: (F.abs(F.col("embedding")[k]) / (F.abs(F.col("embedding")[k]) + F.lit(1).cast("float"))).cast("float").cast("double")
    x = table(spark, sf_dir, "embeddings").select("vec_id", timecode.rgb_to_hsv(c(0), c(1), c(2)).alias("x"))
    return x.select("vec_id", *[F.round(f"x.{k}", 6).alias(k) for k in "hsv"])
