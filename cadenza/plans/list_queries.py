"""Queries of the event-list algebra, matching and alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadenza.functions import timecode
from cadenza.operators import align, eventlist, matching, sweeps
from cadenza.plans.registry import HOUR, SIG, TOL, Registry, marks, marks_sql, signal, table, thin_sql

Q = Registry()
HALF, MERGE, KEEP, MOST = 12 * HOUR, 8 * HOUR, 6 * HOUR, 2
ALL = "e AS (SELECT user_id AS film, epoch_us(ts) AS t FROM events)"


def every(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("film"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))


NEAR = f"WITH {ALL}, n AS (SELECT film, t, count(*) OVER (PARTITION BY film ORDER BY t RANGE BETWEEN {HALF} PRECEDING AND {HALF} FOLLOWING) AS near FROM e)"
CHAIN = NEAR + f""", d AS (SELECT film, t, near > {MOST} AS dense, t - lag(t) OVER (PARTITION BY film ORDER BY t) AS since FROM n),
c AS (SELECT *, sum(CASE WHEN since IS NULL OR (NOT dense AND since >= {MERGE}) THEN 1 ELSE 0 END) OVER (PARTITION BY film ORDER BY t ROWS UNBOUNDED PRECEDING) AS chain FROM d),
r AS (SELECT film, t, chain, max(dense) OVER (PARTITION BY film, chain ORDER BY t ROWS UNBOUNDED PRECEDING) AS in_region FROM c)"""


@Q("density_flags", NEAR + f" SELECT film, t, near, near > {MOST} AS dense FROM n")
def density_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eventlist.density(every(spark, sf_dir), ["film"], "t", HALF).withColumn("dense", F.col("near") > MOST)


@Q("dense_regions", CHAIN + " SELECT film, min(t) AS lo, max(t) AS hi, count(*) AS n FROM r WHERE in_region GROUP BY film, chain")
def dense_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eventlist.dense_regions(every(spark, sf_dir), ["film"], "t", HALF, MOST, MERGE)


@Q("strobe_dampen", CHAIN + f" SELECT film, t FROM r WHERE NOT in_region UNION ALL SELECT film, unnest({thin_sql('list(t ORDER BY t)', str(KEEP))}) AS t FROM r WHERE in_region GROUP BY film, chain")
def strobe_dampen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eventlist.dampen_bursts(every(spark, sf_dir), ["film"], "t", HALF, MOST, MERGE, KEEP)


@Q("strobe_removed", CHAIN + f", k AS (SELECT film, t FROM r WHERE NOT in_region UNION ALL SELECT film, unnest({thin_sql('list(t ORDER BY t)', str(KEEP))}) AS t FROM r WHERE in_region GROUP BY film, chain) SELECT (SELECT count(*) FROM e) - (SELECT count(*) FROM k) AS n_removed")
def strobe_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = eventlist.dampen_bursts(every(spark, sf_dir), ["film"], "t", HALF, MOST, MERGE, KEEP)
    sides = every(spark, sf_dir).select(F.lit(1).alias("n")).unionByName(kept.select(F.lit(-1).alias("n")))
    return sides.agg(F.sum("n").alias("n_removed"))


LO, HI = "epoch_us(TIMESTAMP '2024-01-05')", "epoch_us(TIMESTAMP '2024-01-15')"


def _at(day: str):
    return F.unix_micros(F.lit(day).cast("timestamp"))


@Q("collapse_region", f"WITH {ALL} SELECT film, t FROM e WHERE NOT t BETWEEN {LO} AND {HI} UNION ALL SELECT film, unnest({thin_sql('list(t ORDER BY t)', str(24 * HOUR))}) AS t FROM e WHERE t BETWEEN {LO} AND {HI} GROUP BY film")
def collapse_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eventlist.collapse_region(every(spark, sf_dir), ["film"], "t", _at("2024-01-05"), _at("2024-01-15"), 24 * HOUR)


@Q("first_wins_dedupe", "SELECT user_id AS film, round(value) AS key, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def first_wins_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("film"), F.round("value").alias("key"), "event_id")
    return eventlist.first_wins(e, ["film"], "key", "event_id")


MATCH = f"""
WITH {marks_sql('p', 'click')}, {marks_sql('g', 'view')},
pl AS (SELECT film, list(t ORDER BY t) AS ps FROM p GROUP BY film),
gl AS (SELECT film, list({{'i': i, 't': t}} ORDER BY i) AS gs FROM (SELECT film, t, row_number() OVER (PARTITION BY film ORDER BY t) AS i FROM g) GROUP BY film),
m AS (SELECT film, unnest(list_reduce(
  list_concat([list_filter([{{'p': 0::BIGINT, 'g': 0::BIGINT, 't': 0::BIGINT}}], lambda z: z.p > 0)], list_transform(ps, lambda x: [{{'p': x, 'g': 0::BIGINT, 't': 0::BIGINT}}])),
  lambda a, x: list_concat(a, list_transform(list_sort(list_transform(list_filter(gs, lambda q: abs(q.t - x[1].p) <= {TOL} AND NOT list_contains(list_transform(a, lambda z: z.g), q.i)),
     lambda q: {{'d': abs(q.t - x[1].p), 'n': -q.i, 't': q.t}}))[1:1], lambda b: {{'p': x[1].p, 'g': -b.n, 't': b.t}})))) AS x
  FROM pl JOIN gl USING (film)),
pairs AS (SELECT film, x.p AS pred_time, x.t AS truth_time FROM m)"""  # fmt: skip
PRF = MATCH + """, np AS (SELECT film, count(*) AS n_pred FROM p GROUP BY film), ng AS (SELECT film, count(*) AS n_truth FROM g GROUP BY film), nt AS (SELECT film, count(*) AS tp FROM pairs GROUP BY film),
j AS (SELECT film, coalesce(n_pred, 0) AS n_pred, coalesce(n_truth, 0) AS n_truth, coalesce(tp, 0) AS tp FROM np FULL JOIN ng USING (film) LEFT JOIN nt USING (film)),
q AS (SELECT *, CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 1.0 END AS pr, CASE WHEN n_truth > 0 THEN tp / n_truth ELSE 1.0 END AS rc FROM j),
s AS (SELECT film, tp, n_pred - tp AS fp, n_truth - tp AS fn, round_even(pr, 3) AS precision, round_even(rc, 3) AS recall, round_even(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END, 3) AS f1 FROM q)"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return marks(spark, sf_dir, "click"), marks(spark, sf_dir, "view")


@Q("match_pairs", MATCH + " SELECT * FROM pairs")
def match_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.greedy_match(*_sides(spark, sf_dir), ["film"], "t", TOL)


@Q("match_prf", PRF + " SELECT * FROM s")
def match_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, g = _sides(spark, sf_dir)
    return matching.scores(matching.greedy_match(p, g, ["film"], "t", TOL), p, g, ["film"])


@Q("macro_mean", PRF + " SELECT round(avg(precision), 9) AS mean_precision, round(avg(recall), 9) AS mean_recall, round(avg(f1), 9) AS mean_f1, count(*) AS n_films FROM s")
def macro_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matching.macro_mean(match_prf(spark, sf_dir))
    return found.select(*[F.round(c, 9).alias(c) for c in ("mean_precision", "mean_recall", "mean_f1")], "n_films")


@Q("conditional_mean", PRF + " SELECT round(avg(CASE WHEN film % 3 <> 0 THEN f1 END), 9) AS mean_f1, count(*) AS n_films FROM s")
def conditional_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.macro_mean(match_prf(spark, sf_dir), F.col("film") % 3 != 0).select(F.round("mean_f1", 9).alias("mean_f1"), "n_films")


TRAPS = f"traps AS (SELECT user_id AS film, event_id AS trap_no, event_type AS trap_type, CASE WHEN event_type = 'error' THEN epoch_us(ts) - {8 * HOUR} END AS lo, CASE WHEN event_type = 'error' THEN epoch_us(ts) + {8 * HOUR} END AS hi, epoch_us(ts) AS mark FROM events WHERE event_type IN ('error', 'signup'))"


@Q("trap_hits", f"""
WITH {marks_sql('p', 'click')}, {TRAPS}, h AS (SELECT p.film, p.t, trap_no, trap_type FROM p JOIN traps USING (film)
 WHERE CASE WHEN lo IS NOT NULL THEN p.t > lo + {HOUR} AND p.t < hi - {HOUR} ELSE abs(p.t - traps.mark) <= {HOUR} END)
SELECT film, t, min(trap_no) AS trap_no, arg_min(trap_type, trap_no) AS trap_type FROM h GROUP BY film, t""")  # fmt: skip
def trap_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    wide = F.col("event_type") == "error"
    traps = table(spark, sf_dir, "events").where(F.col("event_type").isin("error", "signup"))
    traps = traps.select(F.col("user_id").alias("film"), F.col("event_id").alias("trap_no"), F.col("event_type").alias("trap_type"), F.when(wide, at - 8 * HOUR).alias("lo"), F.when(wide, at + 8 * HOUR).alias("hi"), at.alias("at"))
    return matching.trap_hits(marks(spark, sf_dir, "click"), traps, ["film"], "t", HOUR)


SPANS = f"spans AS (SELECT user_id AS film, epoch_us(ts) AS lo, epoch_us(ts) + {24 * HOUR} AS hi FROM events WHERE event_type = 'purchase' AND user_id % 4 <> 0)"


@Q("coverage_check", f"WITH {marks_sql('p', 'click')}, {SPANS} SELECT film, t, NOT EXISTS (SELECT 1 FROM spans s WHERE s.film = p.film) OR EXISTS (SELECT 1 FROM spans s WHERE s.film = p.film AND p.t BETWEEN s.lo AND s.hi) AS covered FROM p")
def coverage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = marks(spark, sf_dir, "purchase").where("film % 4 <> 0").select("film", F.col("t").alias("lo"), (F.col("t") + 24 * HOUR).alias("hi"))
    return matching.covered(marks(spark, sf_dir, "click"), spans, ["film"], "t")


NEAREST = f"WITH {marks_sql('p', 'click')}, {marks_sql('g', 'view')}, n AS (SELECT p.film, p.t, g.t AS m, row_number() OVER (PARTITION BY p.film, p.t ORDER BY abs(g.t - p.t), g.t) AS k FROM p LEFT JOIN g ON g.film = p.film AND abs(g.t - p.t) <= {TOL})"


@Q("nearest_kept", NEAREST + " SELECT film, t, m AS match_time FROM n WHERE k = 1")
def nearest_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.nearest(*_sides(spark, sf_dir), ["film"], "t", TOL)


@Q("near_truth_flag", NEAREST + " SELECT film, t, m IS NOT NULL AS near FROM n WHERE k = 1")
def near_truth_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.near_any(*_sides(spark, sf_dir), ["film"], "t", TOL)


REGIONS = "regions AS (SELECT film, n AS region_no, lo, lo + (n + 1) * 86400000000 * 2 AS hi FROM (SELECT film, epoch_us(TIMESTAMP '2024-01-03') + film % 7 * 86400000000 + n * 86400000000 AS lo, n FROM (SELECT DISTINCT user_id AS film FROM events WHERE user_id % 3 <> 0), range(0, 2) r(n) WHERE n = 0 OR film % 2 = 0))"


@Q("region_override", f"""
WITH {marks_sql('b', 'click')}, {marks_sql('h', 'view')}, {REGIONS}, k AS (SELECT film, count(*) AS n FROM regions GROUP BY film),
ev AS (SELECT film, t, -1 AS no FROM b UNION ALL SELECT film, t, region_no FROM h JOIN regions USING (film) WHERE t BETWEEN lo AND hi)
SELECT ev.film, ev.t, CASE WHEN k.n IS NULL THEN 'movienet' WHEN k.n = 1 THEN 'movienet+human' ELSE 'human' END AS kind FROM ev LEFT JOIN k USING (film)
WHERE NOT EXISTS (SELECT 1 FROM regions r WHERE r.film = ev.film AND r.region_no > ev.no AND ev.t BETWEEN r.lo AND r.hi)""")  # fmt: skip
def region_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = 86_400_000_000
    films = table(spark, sf_dir, "events").where("user_id % 3 <> 0").select(F.col("user_id").alias("film")).distinct()
    numbered = films.select("film", F.explode(F.when(F.col("film") % 2 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("region_no"))
    lo = _at("2024-01-03") + F.col("film") % 7 * day + F.col("region_no") * day
    regions = numbered.select("film", "region_no", lo.alias("lo"), (lo + (F.col("region_no") + 1) * day * 2).alias("hi"))
    human = marks(spark, sf_dir, "view").join(regions.select("film", "region_no"), "film")
    return eventlist.override_regions(marks(spark, sf_dir, "click"), human, regions, ["film"], "t")


@Q("candidate_gaps", f"WITH {SIG}, g AS (SELECT *, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY film ORDER BY i)::BIGINT AS gap_no FROM sig) SELECT film, gap_no, count(*) AS n, max(score) AS top FROM g WHERE event_type <> 'click' GROUP BY film, gap_no")
def candidate_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signal(spark, sf_dir, "event_type").withColumn("kept", F.col("event_type") == "click")
    return eventlist.candidate_gaps(s, ["film"], "i", "score", "kept")


@Q("merge_streams", f"WITH {SIG}, u AS (SELECT film, i, score FROM sig WHERE score > 50 UNION ALL SELECT film, i + 1, score FROM sig WHERE event_type = 'view') SELECT film, i, max(score) AS score FROM u GROUP BY film, i")
def merge_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signal(spark, sf_dir, "event_type")
    return eventlist.merge_streams([s.where("score > 50"), s.where("event_type = 'view'").withColumn("i", F.col("i") + 1)], ["film"], "i", "score")


@Q("refine_steps", f"WITH {SIG}, w AS (SELECT film, i / 2.0 AS t, lead(i / 2.0) OVER (PARTITION BY film ORDER BY i) AS a FROM sig WHERE event_type = 'click') SELECT film, t, CAST(greatest(0, round_even((a - t - 0.4) * 24, 0)) AS BIGINT) AS steps FROM w WHERE a IS NOT NULL")
def refine_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signal(spark, sf_dir, "event_type").where("event_type = 'click'").select("film", (F.col("i") / 2).alias("t"))
    return eventlist.refine_steps(s, ["film"], "t", 0.2, 24.0)


@Q("ascending_check", "WITH w AS (SELECT user_id AS film, event_id, round(value) AS t, lag(round(value)) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) SELECT film, event_id, CASE WHEN t = b THEN 'duplicate' ELSE 'descending' END AS problem FROM w WHERE t <= b")
def ascending_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("film"), "event_id", F.round("value").alias("t"))
    return eventlist.ascending(e, ["film"], "t", "event_id").select("film", "event_id", "problem")


DIFFS = f"WITH {marks_sql('r', 'view')}, {marks_sql('m', 'click')}, d AS (SELECT m.film, m.t - r.t AS d FROM m JOIN r USING (film))"
VOTE = DIFFS + f""", c AS (SELECT film, d, count(*) OVER (PARTITION BY film ORDER BY d RANGE BETWEEN {2 * TOL} PRECEDING AND CURRENT ROW) AS n, row_number() OVER (PARTITION BY film ORDER BY d) AS rn FROM d),
b AS (SELECT film, n, rn, row_number() OVER (PARTITION BY film ORDER BY n DESC, d, rn DESC) AS k FROM c)
SELECT b.film, c.d AS "offset", b.n AS votes FROM b JOIN c ON c.film = b.film AND c.rn = (2 * b.rn - 1 - b.n) // 2 + 1 WHERE b.k = 1"""


@Q("vote_offset", VOTE)
def vote_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref, own = marks(spark, sf_dir, "view"), marks(spark, sf_dir, "click")
    pairs = own.select("film", F.col("t").alias("_m")).join(ref.select("film", F.col("t").alias("_r")), "film")
    return align.densest(pairs.select("film", (F.col("_m") - F.col("_r")).alias("_d")), ["film"], 2 * TOL)


@Q("affine_fit", MATCH + ", h AS (SELECT film, (pred_time - 1704067200000000) / 3.6e9 AS x, (truth_time - 1704067200000000) / 3.6e9 AS y FROM pairs) SELECT film, round(regr_slope(y, x), 5) AS slope, round(regr_intercept(y, x), 4) AS intercept, count(*) AS n FROM h GROUP BY film HAVING count(DISTINCT x) > 1")
def affine_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = lambda c: ((F.col(c) - 1704067200000000) / 3.6e9)
    met = match_pairs(spark, sf_dir).select("film", hours("pred_time").alias("x"), hours("truth_time").alias("y"))
    found = align.affine_fit(met, ["film"], "x", "y").where("n > 1")
    return found.select("film", F.round("slope", 5).alias("slope"), F.round("intercept", 4).alias("intercept"), "n")


@Q("remap", f"WITH {SIG}, r AS (SELECT film, i, round(1.001 * (i / 3.0) - 2.5, 4) AS t FROM sig) SELECT film, i, t FROM r WHERE t >= 0")
def remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signal(spark, sf_dir).select("film", "i", timecode.affine(F.col("i") / 3, 1.001, -2.5).alias("t"))
    return s.where("t >= 0")


@Q("sync_best", """SELECT user_id AS film, round(25 / 24.0, 6)::DOUBLE AS scale, 4.0::DOUBLE AS "offset", count(*) AS matched, count(*) AS ref_cuts, count(*) AS your_cuts,
 1.0::DOUBLE AS match_rate, 1.0::DOUBLE AS precision, 1.0::DOUBLE AS recall FROM events WHERE event_type IN ('click', 'view') GROUP BY user_id""")  # fmt: skip
def sync_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of each film's steps with a copy at another rate: the search must find the shift that made the copy."""
    s = signal(spark, sf_dir, "event_type").where("event_type IN ('click', 'view')")
    own = s.select("film", (F.col("i") * 7.3 + F.col("score") % 5).alias("t"))
    ref = own.select("film", ((F.col("t") - 4.0) * (24.0 / 25.0)).alias("t"))
    return align.synchronise(ref, own, ["film"]).drop("fps_hint")


@Q("quota_per_class", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n <= 5")
def quota_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eventlist.quota(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", ["doc_id"], 5)


LADDER = [round(0.5 - 0.05 * k, 2) for k in range(9)]
SWEEP = f"WITH c AS (SELECT l.toxic, l.doc_id, least(d.n_chars / 5000.0, 1.0) AS p FROM labels l JOIN documents d USING (doc_id)), t AS (SELECT unnest([{', '.join(map(str, LADDER))}])::DOUBLE AS thr)"


def _clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.least(F.col("n_chars") / 5000, F.lit(1.0)).alias("p"))
    return table(spark, sf_dir, "labels").select("doc_id", "toxic").join(d, "doc_id")


@Q("threshold_sweep", SWEEP + " SELECT thr, toxic, round(avg(CASE WHEN p > thr THEN 1.0 ELSE 0.0 END), 9) AS fired, count(*) AS n FROM c, t GROUP BY thr, toxic")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sweeps.fired_share(_clips(spark, sf_dir), "toxic", "p", LADDER)
    return found.select("thr", "toxic", F.round("fired", 9).alias("fired"), "n")


@Q("first_firing_threshold", SWEEP + " SELECT doc_id, max(CASE WHEN p > thr THEN thr END) AS thr FROM c, t GROUP BY doc_id")
def first_firing_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweeps.first_firing(_clips(spark, sf_dir), ["doc_id"], "p", LADDER)


BOUNDS = f"WITH {SIG}, c AS (SELECT film, i / 4.0 AS s, 1 AS side FROM sig WHERE event_type = 'click'), d AS (SELECT film, max(i) / 4.0 AS duration FROM sig GROUP BY film), b AS (SELECT * FROM c UNION ALL SELECT film, 0.0, 0 FROM d UNION ALL SELECT film, duration, 2 FROM d), w AS (SELECT film, s AS start, lead(s) OVER k AS stop, row_number() OVER k AS shot_no FROM b WINDOW k AS (PARTITION BY film ORDER BY side, s))"


def shots(spark: SparkSession, sf_dir: str, skip_empty: bool = True) -> DataFrame:
    s = signal(spark, sf_dir, "event_type")
    cuts = s.where("event_type = 'click'").select("film", (F.col("i") / 4).alias("t"))
    return eventlist.intervals(cuts, ["film"], "t", s.groupBy("film").agg((F.max("i") / 4).alias("duration")), skip_empty)


@Q("shot_intervals", BOUNDS + ' SELECT film, shot_no, CAST(start AS DOUBLE) AS start, CAST(stop AS DOUBLE) AS "end" FROM w WHERE stop > start')
def shot_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shots(spark, sf_dir)


@Q("kill_set", f"WITH {ALL}, k AS (SELECT film, t FROM e WHERE t % 7 = 0) SELECT e.film, e.t FROM e ANTI JOIN k USING (film, t)")
def kill_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = every(spark, sf_dir)
    return e.join(e.where("t % 7 = 0"), ["film", "t"], "left_anti")


@Q("shot_reference_cuts", "WITH s AS (SELECT l_orderkey AS film, l_linenumber AS start_frame, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n, CASE WHEN l_quantity > 25 THEN l_quantity END AS fps FROM lineitem) SELECT film, n, round_even(start_frame / coalesce(fps, 24.0), 4) AS t FROM s WHERE n > 1")
def shot_reference_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts of every shot after the first; an unknown rate counts as 24."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    li = table(spark, sf_dir, "lineitem").withColumn("n", F.row_number().over(w).cast("long")).where("n > 1")
    fps = F.coalesce(F.when(F.col("l_quantity") > 25, F.col("l_quantity")), F.lit(24.0))
    return li.select(F.col("l_orderkey").alias("film"), "n", timecode.frame_time(F.col("l_linenumber"), fps).alias("t"))
