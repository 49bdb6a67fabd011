"""Alignment over whole lists: what is shuffled, and each step against a plain form of it."""

import random

import numpy as np
import pytest

from cadenza.operators import align, matching, sweeps


def shuffled(spark, df):
    """Rows of ``df``, and the bytes that Spark wrote to shuffle files for them."""
    context = spark.sparkContext._jsc.sc()

    def written():
        context.listenerBus().waitUntilEmpty(30_000)
        return context.statusStore().executorList(True).apply(0).totalShuffleWrite()

    before = written()
    return df().collect(), written() - before


def shifted_films(spark, films, n, keep=1.0, seed=3):
    rng = random.Random(seed)
    own = [(f, rng.uniform(0, 40 * n)) for f in range(films) for _ in range(n)]
    ref = [(f, (t - 4.0) * 24 / 25) for f, t in own if rng.random() < keep]
    return spark.createDataFrame(ref, "film int, t double"), spark.createDataFrame(own, "film int, t double")


def test_corpus_scores_shuffle_no_more_than_the_lists(spark):
    ref, own = shifted_films(spark, 20, 60)
    found, size = shuffled(spark, lambda: sweeps.corpus_scores(own.select("film"), ref, own, ["film"]))
    assert len(found) == 20 and all((r["f1"], r["scale"], r["offset"]) == (1, 1.041667, 4) for r in found)
    assert size < 20 * 120 * 40


def test_corpus_scores_equal_matching_of_the_remapped_lists(spark):
    ref, own = shifted_films(spark, 6, 50, 0.7)
    more = spark.createDataFrame([(0, -500.0), (0, None), (1, float("nan")), (7, 1.0), (8, None), (None, 2.0)], "film int, t double")
    ref, own = ref.unionByName(more), own.unionByName(more.where("film is null or film not in (0)")).unionByName(spark.createDataFrame([(f, -400.0 - 3 * k) for f in range(6) for k in range(30)], "film int, t double"))
    found = {r["film"]: r for r in sweeps.corpus_scores(own.select("film"), ref, own, ["film"]).collect()}
    assert set(found) == {0, 1, 2, 3, 4, 5, 7}
    synced = align.synchronise(ref, own, ["film"], tol=0.5)
    moved = ref.join(synced, "film").selectExpr("film", "bround(scale * t + offset, 4) as t").where("t >= 0")
    finite = [df.where("not isnan(t)") for df in (own, moved)]
    for r in matching.scores(matching.greedy_match(*finite, ["film"], "t", 0.5), own, moved.where("not isnan(t)"), ["film"]).where("film is not null").collect():
        if r["film"] in found:
            assert [found[r["film"]][c] for c in ("precision", "recall", "f1")] == [r[c] for c in ("precision", "recall", "f1")]


def test_sync_shuffles_no_more_than_the_lists(spark):
    ref, own = shifted_films(spark, 20, 60)
    found, size = shuffled(spark, lambda: align.synchronise(ref, own, ["film"]))
    assert len(found) == 20 and all((r["matched"], r["scale"], r["offset"]) == (60, 1.041667, 4) for r in found)
    assert size < 20 * 120 * 40


def test_long_lists_beside_short_ones_and_nothing(spark):
    ref, own = shifted_films(spark, 1, 700)
    short, other = ([(1, 5.0), (1, None), (2, None), (3, 1.0), (4, float("inf"))], [(1, 9.0), (2, 1.0), (4, 3.0), (None, 1.0)])
    ref, own = ref.unionByName(spark.createDataFrame(short, "film int, t double")), own.unionByName(spark.createDataFrame(other, "film int, t double"))
    found = {r["film"]: r for r in align.synchronise(ref, own, ["film"]).collect()}
    assert set(found) == {0, 1}
    assert (found[0]["matched"], found[0]["scale"], found[0]["offset"]) == (700, 1.041667, 4) and found[0]["recall"] == 1
    assert (found[1]["matched"], found[1]["scale"], found[1]["offset"], found[1]["ref_cuts"]) == (1, 1, 4, 2)


def plain_vote(own, ref, width):
    d = sorted(m - r for m in own for r in ref)
    return max((i + 1 - next(j for j, x in enumerate(d) if x >= y - width), -y, i) for i, y in enumerate(d)), d


@pytest.mark.parametrize("step", [0, 0.5, 4])
@pytest.mark.parametrize("held", [1 << 22, 40, 1])
def test_votes_of_long_and_short_lists(monkeypatch, step, held):
    monkeypatch.setattr(align, "HELD", held)
    rng = random.Random(11)
    for _ in range(30):
        own, ref = (np.array(sorted(rng.uniform(-30, 60) if not step else step * rng.randint(-20, 20) for _ in range(rng.randint(1, 25)))) for _ in range(2))
        (votes, _, i), d = plain_vote(own, ref, 1.5)
        expected = d[(2 * i + 1 - votes) // 2]
        assert align._vote(own, ref, 1.5) == expected
        a, b = np.append(own, [np.inf] * 3), np.append(ref, [-np.inf] * 2)
        assert align._votes(a[None], b[None, None], np.array([len(own)]), np.array([len(ref)]), 1.5).tolist() == [[expected]]


@pytest.mark.parametrize("short", [256, 3])
def test_matches_of_lists_equal_the_greedy_ones(monkeypatch, short):
    monkeypatch.setattr(matching, "SHORT", short)
    rng = random.Random(12)
    pred, truth = (np.array([sorted([float(rng.randint(0, 60)) / 2 for _ in range(n)]) + [np.inf] * (20 - n) for n in [rng.randint(1, 20) for _ in range(200)]]) for _ in range(2))
    found = matching.match_lists(pred, truth, 1.5)
    for p_row, t_row, row in zip(pred, truth, found, strict=True):
        left = [(t, k) for k, t in enumerate(t_row) if t < np.inf]
        for p, got in zip(p_row, row, strict=True):
            best = min(((abs(t - p), -k, (t, k)) for t, k in left if abs(t - p) <= 1.5), default=None) if p < np.inf else None
            assert (best is None and np.isnan(got)) or got == best[2][0]
            if best:
                left.remove(best[2])
