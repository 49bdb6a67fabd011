"""Readers and writers on files, the synthetic signal, and the streaming forms."""

import json

from pyspark.sql import functions as F

from cadenza import sources, streaming
from cadenza.operators import detectors, eventlist, matching, series


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_shot_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("0 10 1 2 3\nnothing\n11 20 4 5 6\n")
    (tmp_path / "b.txt").write_text("1 0 10 1 2 3\n2 11 20 4 5 6\n")
    found = sources.read_shots(spark, f"{tmp_path}/*.txt").select(F.element_at(F.split("file", "/"), -1), "start_frame", "end_frame")
    assert rows(found) == [("a.txt", 0, 10), ("a.txt", 11, 20), ("b.txt", 0, 10), ("b.txt", 11, 20)]


def test_json_readers(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"video": "v", "fps": 24.0, "cuts": [1.5, 2.5]}))
    assert [r["t"] for r in sources.read_cut_lists(spark, f"{tmp_path}/c.json").collect()] == [1.5, 2.5]
    movies = {"movies": [{"name": "a", "imdb": "t1", "base": {"kind": "movienet", "path": "p"}, "overrides": [{"kind": "human", "path": "q", "region": [1.0, 2.0]}]}, {"name": "b", "imdb": "t2", "base": {"kind": "none"}}]}
    (tmp_path / "s.json").write_text(json.dumps(movies))
    found = sources.read_sources(spark, f"{tmp_path}/s.json").select("name", "base.kind", "override.region")
    assert rows(found) == [("a", "movienet", [1.0, 2.0]), ("b", "none", None)]


def test_video_discovery_reads_names_only(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "f.mp4").write_bytes(b"12345")
    (tmp_path / "g.txt").write_text("no")
    found = sources.discover(spark, str(tmp_path)).collect()
    assert [(r["path"].rpartition("/")[2], r["size_bytes"]) for r in found] == [("f.mp4", 5)] and found[0]["mtime_utc"].endswith("Z")


def test_written_subtitles_read_back(spark, tmp_path):
    cuts = spark.createDataFrame([(1, 1.5), (1, 4.0)], "film int, t double")
    ends = spark.createDataFrame([(1, 9.0)], "film int, duration double")
    shots = eventlist.intervals(cuts, ["film"], "t", ends)
    sources.write_entries(sources.srt_entries(shots, ["film"]), ["film"], f"{tmp_path}/srt")
    text = spark.read.text(f"{tmp_path}/srt/film=1", wholetext=True)
    assert text.first()["value"].startswith("1\n00:00:00,000 --> 00:00:01,500\nShot 1\n\n2\n")
    assert text.select(sources.srt_cuts(F.col("value"))).first()[0] == [1.5, 4.0]
    sources.write_csv(cuts, ["film"], "t", 25, f"{tmp_path}/csv")
    assert (next((tmp_path / "csv" / "film=1").glob("*.csv"))).read_text().splitlines()[:2] == ["cut_index,time_seconds,timecode", "1,1.500,00:00:01:13"]


def test_logs_and_keywords(spark):
    df = spark.createDataFrame([("n:0 pts_time:1.5 x\nn:1 pts_time:20 y", "A Film By-NAME")], "log string, path string")
    assert df.select(sources.showinfo_times(F.col("log"))).first()[0] == [1.5, 20.0]
    assert df.select(sources.keyword_id(F.col("path"), [("zzz", "1"), ("name", "2"), ("film", "3")])).first()[0] == "2"


def test_detector_on_the_synthetic_signal(spark):
    scores, truth = sources.synthetic_scores(spark, 4, 2000)
    found = series.spikes(scores, ["film"], "i", "score").select("film", "i")
    met = matching.greedy_match(found, truth, ["film"], "i", 1)
    for r in matching.scores(met, found, truth, ["film"]).collect():
        assert r["recall"] == 1.0 and r["precision"] > 0.7


def test_registry_names():
    assert set(detectors.REGISTRY) >= {"torch-cpu", "transnet-cpu", "motion-vectors"} and len(detectors.REGISTRY) == 9


def run_stream(spark, tmp_path, batches, make, name):
    source = tmp_path / "in"
    source.mkdir()
    stream = spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "check")).start()
    try:
        for n, b in enumerate(batches):
            b.coalesce(1).write.mode("append").parquet(str(source))
            query.processAllAvailable()
    finally:
        query.stop()
    return spark.table(name)


def test_streamed_spikes_equal_batch_spikes(spark, tmp_path):
    scores, _ = sources.synthetic_scores(spark, 2, 400)
    batches = [scores.where(f"i >= {a} AND i < {a + 150}") for a in (0, 150, 300)]
    found = run_stream(spark, tmp_path, batches, lambda s: streaming.spikes(s, timeout_ms=None), "spikes_out")
    batch = series.spikes(scores, ["film"], "i", "score").where("i < 385").select("film", "i")  # later steps wait for their neighbours
    assert rows(found.select("film", "i")) == rows(batch)


def test_streamed_differences_cross_batches(spark, tmp_path):
    frames = spark.createDataFrame([(1, i, [float(i * i), 1.0]) for i in range(6)], "film int, i long, pixels array<double>")
    found = run_stream(spark, tmp_path, [frames.where("i < 3"), frames.where("i >= 3")], streaming.differences, "diff_out")
    expected = series.frame_difference(frames, ["film"], "i", "pixels").select("film", "i", "score")
    assert rows(found) == rows(expected)
