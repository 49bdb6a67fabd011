import json

from pyspark.sql import functions as F

from cadenza.sources import results


def test_images_are_cut_at_their_markers(spark):
    a, b = b"\xff\xd8one\xff\xd9", b"\xff\xd8two\xff\xd9"
    df = spark.createDataFrame([(b"x" + a + b + b"\xff\xd8torn",), (None,), (b"",)], "raw binary")
    assert [[bytes(x) for x in r[0]] for r in df.select(results.split_images(F.col("raw"))).collect()] == [[a, b], [], []]


def test_sessions_need_candidates(spark, tmp_path):
    for name in ("label_b", "label_a", "other"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "candidates.json").write_text("[]")
    (tmp_path / "label_c").mkdir()
    assert [r["name"] for r in results.sessions(spark, str(tmp_path)).collect()] == ["a", "b"]


def test_median_of_neighbouring_images(spark):
    df = spark.createDataFrame([(1, i, [float(i), float(i % 2)]) for i in range(4)], "film int, i int, pixels array<double>")
    found = {r["i"]: r["median"] for r in results.median_image(df, ["film"], "i", "pixels", -1, 1).collect()}
    assert found == {0: [0.5, 0.5], 1: [1.0, 0.0], 2: [2.0, 1.0], 3: [2.5, 0.5]}


def test_small_projections(spark):
    row = spark.range(1).select(results.label_frames(F.lit(2), 5, F.lit(6)).alias("a"), results.grid_place(F.lit(7), 3).alias("b")).first()
    assert tuple(row["a"]) == (0, 5) and tuple(row["b"]) == (2, 1)
    frames = spark.createDataFrame([(1, f) for f in range(5)], "film int, frame int")
    assert [r["batch_no"] for r in results.score_stream(frames, ["film"], 2).orderBy("frame").collect()] == [0, 0, 1, 1, 2]


def test_documents_of_results(spark):
    runs = spark.createDataFrame([(1, 240, 2.0, 24.0), (2, 10, 0.0, 24.0)], "film int, n_frames long, elapsed double, fps double")
    events = spark.createDataFrame([(1, 3.0), (1, 1.0)], "film int, time double")
    one, two = results.run_summaries(runs, events, ["film"]).orderBy("film").collect()
    assert (one["cuts"], one["n_cuts"], one["analysed_fps"], one["realtime_x"]) == ([1.0, 3.0], 2, 120.0, 5.0)
    assert two["cuts"] == [] and two["analysed_fps"] != two["analysed_fps"]
    regions = spark.createDataFrame([(1, 0.0, 9.0, 24.0)], "film int, lo double, hi double, fps double")
    assert json.loads(results.canonical_documents(events, regions, ["film"]).first()["document"]) == {"region": [0.0, 9.0], "fps": 24.0, "cuts": [1.0, 3.0]}
    shots = spark.createDataFrame([(1, 0, 23), (1, 24, 47), (1, 48, 95)], "film int, start_frame long, end_frame long")
    assert json.loads(results.truth_documents(shots, ["film"], 24).first()["document"]) == {"fps": 24.0, "n_frames": 96, "duration_s": 4.0, "cuts": [1.0, 2.0]}
