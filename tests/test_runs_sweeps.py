"""Run diagnostics, frame tables, sweeps and the harness against plain versions."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza import harness
from cadenza.functions import timecode
from cadenza.operators import align, detectors, eventlist, folds, images, lineage, matching, runs, sweeps
from cadenza.sources import frames


def test_documents_from_runs_break_no_rule(spark):
    columns = "film int, video string, detector_key string, detector string, fps double, n_frames long, container string, streams array<string>, size_bytes long, mtime_utc string, decode_ok boolean, decode_detail string, warning string"
    rows = [
        (1, "a.mp4", "transnet-cuda", "net", 25.0, 100, "10.0", None, 5, "2024-01-01T00:00:00Z", True, None, None),
        (2, "b.mp4", "psd-content", "psd", 25.0, 100, "N/A", ["x", "8.5", "3"], 5, "2024-01-01T00:00:00Z", False, "bad", None),
        (3, "c.mp4", "other", "o", 25.0, 100, None, [], 5, "2024-01-01T00:00:00Z", False, None, "fixed gop"),
        (4, "d.mp4", "torch-cpu", "t", 25.0, 0, None, None, 5, "2024-01-01T00:00:00Z", True, None, ""),
    ]
    told = spark.createDataFrame(rows, columns)
    events = spark.createDataFrame([(1, 2.0, 50, "gradual", 1.5, 2.5), (1, 1.0, 25, "hard", None, None), (2, 3.0, 75, "unknown", None, None)], "film int, time double, frame long, kind string, span_start double, span_end double")
    found = {r["film"]: json.loads(r["document"]) for r in runs.documents_from_runs(told, events, ["film"], "cadenza").collect()}
    assert {f: d["analysis"]["status"] for f, d in found.items()} == {1: "complete", 2: "partial", 3: "failed", 4: "complete"}
    assert found[1]["run"]["detector_id"] == "transnetv2" and found[1]["run"]["backend"] == "cuda" and "model" in found[1]["run"] and found[1]["run"]["settings"] == {}
    assert found[2]["analysis"]["warnings"] == ["bad", runs.FROM_STREAM] and found[2]["source"]["duration_seconds"] == 8.5
    assert found[3]["analysis"]["warnings"] == [runs.DECODER_FAILED, "fixed gop", runs.FROM_FRAMES] and found[3]["run"]["detector_id"] == "other" and "backend" not in found[3]["run"]
    assert found[4]["analysis"]["warnings"] == [runs.NO_DURATION] and found[4]["analysis"]["coverage"] == [] and "duration_seconds" not in found[4]["source"]
    assert found[1]["cuts"] == [1.0, 2.0] and found[1]["cut_events"][1]["span"] == {"start": 1.5, "end": 2.5}
    late = spark.createDataFrame([(1, 99.0, 50, "hard", None, None)], events.schema)
    with pytest.raises(Exception, match="rules broken: coverage"):
        runs.documents_from_runs(told.where("film = 1"), late, ["film"], "cadenza").collect()
    with pytest.raises(Exception, match="fps must be positive"):
        runs.documents_from_runs(told.withColumn("fps", F.lit(0.0)), events, ["film"], "cadenza").collect()


def test_raw_frames_drop_the_torn_tail(spark, tmp_path):
    whole = bytes(range(24)) * 3
    (tmp_path / "a.rgb").write_bytes(whole + b"torn")
    (tmp_path / "b.rgb").write_bytes(b"")
    found = frames.read_raw(spark, str(tmp_path), 4, 2).orderBy("frame").collect()
    assert [(r["frame"], bytes(r["pixels"])) for r in found] == [(i, bytes(range(24))) for i in range(3)]
    assert [r["frame"] for r in frames.read_raw(spark, str(tmp_path), 4, 2, first=1, last=1).collect()] == [1]
    assert frames.region_frames(10.0, 12.0, 1.0, 25.0) == (225, 325) and frames.region_frames(0.5, 1.0, 2.0, 10.0)[0] == 0


def test_canonical_and_candidate_documents(spark):
    movies = spark.createDataFrame([("tt1", "One", "v", None), ("tt2", "Two", None, "todo")], "imdb string, name string, video string, status string")
    resolved = spark.createDataFrame([("tt1", 2.0, "human"), ("tt1", 1.0, "human")], "imdb string, time double, kind string")
    found = {r["imdb"]: json.loads(r["entry"]) for r in frames.canonical_results(resolved, movies, "imdb").collect()}
    assert found == {"tt1": {"name": "One", "video": "v", "source": "human", "n_cuts": 2, "cuts": [1.0, 2.0]}, "tt2": {"name": "Two", "source": "none", "status": "todo"}}
    sessions = spark.createDataFrame([(1, "v", "n", 0.0, 9.0, 24.0)], "s int, video string, name string, start double, end double, fps double")
    candidates = spark.createDataFrame([(1, 2.0, 0.5, True), (1, 1.0, 0.9, False)], "s int, time double, prob double, kept boolean")
    document = json.loads(frames.candidate_documents(candidates, sessions, ["s"]).first()["document"])
    assert [c["time"] for c in document["candidates"]] == [1.0, 2.0] and document["candidates"][1]["kept"] is True


def test_registered_detectors_tell_their_settings(spark):
    rng = random.Random(2)
    values = [(1, i, 60.0 if i in (5, 20, 30, 41) else rng.random()) for i in range(60)]
    df = spark.createDataFrame(values, "film int, frame long, change double")
    events, run = detectors.detect("psd-content", df, ["film"], threshold=50.0)
    assert run["detector_id"] == "psd-content" and run["backend"] == "cpu" and run["settings"]["threshold"] == 50.0 and run["settings"]["min_length"] == 15
    assert sorted(r["time"] for r in events.collect()) == [round(f / 24, 4) for f in (20, 41)]  # 5 and 30 come too soon
    ratio, _ = detectors.detect("psd-adaptive", df, ["film"])
    assert sorted(r["time"] for r in ratio.collect()) == [round(f / 24, 4) for f in (20, 41)]


def test_changes_of_images(spark):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 255, (12, 12)).astype(float)
    b = np.roll(a, (4, 0), (0, 1))
    row = spark.createDataFrame([(a.ravel().tolist(), b.ravel().tolist()), (None, [1.0])], "a array<double>, b array<double>").select(images.changes(F.col("a"), F.col("b"), 12).alias("c")).collect()
    c = row[0]["c"]
    assert c["raw"] == pytest.approx(np.abs(a - b).mean()) and c["edge_shifted"] < c["edge"] and row[1]["c"]["raw"] is None


def test_probed_lengths_and_tracks(spark):
    df = spark.createDataFrame([("10.5", ["3"], 1.0), ("N/A", ["3", "x", "4.5"], 2.0), (None, None, None), ("-3", ["inf", "0"], 7.0)], "c string, s array<string>, last double")
    found = df.select(runs.probed_duration(F.col("c"), F.col("s")).alias("p"), runs.subtitle_duration(F.lit(None), F.lit(0), F.lit(25.0), F.lit(None).cast("double"), F.col("last")).alias("t")).collect()
    assert [tuple(r["p"]) for r in found] == [(10.5, "container"), (4.5, "stream"), (None, None), (None, None)] and [r["t"] for r in found] == [6.0, 7.0, 5.0, 12.0]


def test_corpus_scores_of_a_shifted_reference(spark):
    rng = random.Random(6)
    own = {f: sorted(rng.uniform(0, 2000) for _ in range(40)) for f in (1, 2)}
    reference = [(1, (t - 4.0) * 24 / 25) for t in own[1][:36]] + [(2, t) for t in own[2]] + [(3, 5.0)]
    films = spark.createDataFrame([(1,), (2,), (3,), (None,)], "film int")
    found = {r["film"]: r for r in sweeps.corpus_scores(films, spark.createDataFrame(reference, "film int, t double"), spark.createDataFrame([(f, t) for f, ts in own.items() for t in ts], "film int, t double"), ["film"]).collect()}
    assert set(found) == {1, 2} and found[1]["recall"] == 1 and found[1]["precision"] == 0.9 and found[1]["scale"] == pytest.approx(25 / 24, abs=1e-4) and found[2]["f1"] == 1


def test_one_dense_film_folds_in_time_in_proportion(spark):
    n = 60_000
    a = spark.range(n).select(F.lit(1).alias("film"), (F.col("id") * 10).alias("t"))
    b = spark.range(n).select(F.lit(1).alias("film"), (F.col("id") * 10 + 3).alias("t"))
    with harness.Timer() as timer:
        assert matching.greedy_match(a, b, ["film"], "t", 400).count() == n
        assert folds.thin(a, ["film"], "t", 25).count() == n // 3
        assert matching.nearest(a, b, ["film"], "t", 400).where("match_time is not null").count() == n
        assert eventlist.dampen_bursts(a, ["film"], "t", 100, 8, 40, 250).count() < n // 20
    assert timer.elapsed < 90


def test_matches_of_random_lists_equal_the_plain_greedy_one(spark):
    rng = random.Random(8)
    pred, truth, expected = [], [], []
    for film in range(30):
        p, g = sorted(rng.randrange(60) for _ in range(12)), [rng.randrange(60) for _ in range(12)]
        pred += [(film, t) for t in p]
        truth += [(film, t, n) for n, t in enumerate(g)]
        left = list(enumerate(g))
        for t in p:
            near = [x for x in left if abs(x[1] - t) <= 3]
            if near:
                best = max(near, key=lambda x: (-abs(x[1] - t), x[0]))
                left.remove(best)
                expected.append((film, t, best[1]))
    found = matching.greedy_match(spark.createDataFrame(pred, "film int, t long"), spark.createDataFrame(truth, "film int, t long, list_no int"), ["film"], "t", 3)
    assert sorted(map(tuple, found.collect())) == sorted(expected)


def test_the_densest_cluster_of_random_differences(spark):
    rng = random.Random(9)
    rows, expected = [], {}
    for film in range(20):
        d = sorted(rng.uniform(0, 40) for _ in range(60))
        rows += [(film, x) for x in d]
        best = max(range(60), key=lambda k: (sum(d[k] - 1.5 <= x <= d[k] for x in d), -k))
        inside = [x for x in d if d[best] - 1.5 <= x <= d[best]]
        expected[film] = (len(inside), inside[(len(inside) - 1) // 2] if len(inside) % 2 else None)
    for r in align.densest(spark.createDataFrame(rows, "film int, _d double"), ["film"], 1.5).collect():
        votes, middle = expected[r["film"]]
        assert r["votes"] == votes and (middle is None or r["offset"] == middle)


def test_provenance_is_never_made_up(spark, tmp_path):
    assert harness.provenance(str(tmp_path / "none")) == (None, None) and harness.provenance("/") == (None, None)
    row = spark.range(1).select(timecode.drop_none(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(None).cast("int"))).alias("m"), timecode.in_region(F.lit(2.0), 2.0, 3.0).alias("i"), timecode.in_region(F.lit(None).cast("double"), 2.0, 3.0).alias("n")).first()
    assert row["m"] == {"a": 1} and row["i"] is True and row["n"] is False


def test_harness_and_lineage(spark):
    assert harness.run_all(spark.range(10)) > 0
    wall, each = harness.run_together([lambda: spark.range(5), lambda: spark.range(6)])
    assert len(each) == 2 and wall >= max(each)
    cut = lineage.cut(spark.range(5).withColumn("x", F.col("id") * 2))
    assert cut.count() == 5 and "ExistingRDD" in cut._jdf.queryExecution().executedPlan().toString()
