"""The near-duplicate stage against all pairs."""

import random

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest

from cadenza.llm import shingles, simhash
from cadenza.llm.bktree import PackedBKTree
from tests.llm.helpers import AWKWARD, awkward, empty, rows

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def slow_components(texts):
    """The smallest index reachable over 5-word Jaccard similarities of 0.8 or more."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    out = list(range(len(sets)))
    changed = True
    while changed:
        changed = False
        for i in range(len(sets)):
            for j in range(len(sets)):
                same = sets[i] == sets[j] or 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))
                if out[j] < out[i] and same:
                    out[i], changed = out[j], True
    return out


def near_copies():
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(4000)]
    line = rng.choices(words, k=25)
    base = [rng.choices(words, k=rng.choice([8, 40, 90, 200])) + line * (i % 2) for i in range(30)]
    made = [list(b) for b in base]
    for b in base[:20]:
        for _ in range(6):
            c = list(b)
            for _ in range(rng.choice([1, 1, 2, 3, 5])):
                c[rng.randrange(len(c))] = rng.choice(words)
            made.append(c + rng.choices(words, k=rng.choice([0, 0, 3, 12])))
    rng.shuffle(made)
    return [" ".join(m) for m in made]


@pytest.mark.parametrize(("block", "small"), [(1024, 32), (1024, 2), (3, 2)])
def test_groups_match_all_pairs(spark, block, small, monkeypatch):
    monkeypatch.setattr(shingles, "SMALL", small)
    texts = near_copies()
    expected = slow_components(texts)
    assert len(set(expected)) < len(texts) - 20
    found = simhash.similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), block=block)
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == dict(enumerate(expected))


def test_the_stage_drops_near_copies(spark):
    texts = near_copies()
    expected = sorted(i for i, c in enumerate(slow_components(texts)) if i == c)
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    kept = dict(corpus_pipeline.STAGES)["simhash_dedup"](spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == expected and kept.columns == docs.columns


def test_awkward_and_empty_rows(spark):
    found = simhash.similar(awkward(spark, True))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["component_id"] or 0) for r in found.collect()) == sorted((i is None, i or 0, {2: 1, 6: 1, 4: 3}.get(i, i) or 0) for i, *_ in AWKWARD)
    assert rows(simhash.similar(empty(spark))) == []


def test_trees_find_all_within_the_radius():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 1 << 63, 700).astype(np.uint64)
    values[:300] = values[0] ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    for radius in (0, 3, 24):
        found = {(int(a), int(b)) for i, j in PackedBKTree(values).within(values, radius) for a, b in zip(i, j, strict=True)}
        i, j = np.nonzero(np.bitwise_count(values[:, None] ^ values[None, :]) <= radius)
        assert found == set(zip(i.tolist(), j.tolist(), strict=True))


def test_sets_and_fingerprints_match_plain_ones():
    texts = [None, "", "  ", "A b", "a  B\t", "a b c d e", "a b c d e f a b c d e f", "été Été x y z w v"]
    members, offsets = shingles.shingle_sets(pa.array([t or "" for t in texts], pa.large_string()))
    sets = [set(members[s:e].tolist()) for s, e in zip(offsets, offsets[1:], strict=False)]
    assert [len(s) for s in sets] == [0, 0, 0, 1, 1, 1, 6, 3] and sets[3] == sets[4] and sets[5] < sets[6]
    plain = [sum(1 << b for b in range(64) if sum(m >> b & 1 for m in s) * 2 > len(s)) for s in sets]
    assert shingles.simhashes(members, offsets).tolist() == plain
    for s, row in zip(sets, shingles.parities(members, offsets), strict=True):
        odd = np.zeros(shingles.PARITIES, int)
        for m in s:
            odd[m % shingles.PARITIES] ^= 1
        assert np.unpackbits(row, bitorder="little").tolist() == odd.tolist()


def test_one_id_for_several_texts(spark):
    texts = near_copies()[:60]
    docs = spark.createDataFrame([(None if i % 3 else 5, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = simhash.similar(docs).groupBy("fp").count().count()
    assert found == len({frozenset(s) for s in map(_plain, texts)})


def _plain(t):
    w = t.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def test_texts_that_share_a_line_are_no_candidates(spark, monkeypatch):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(4000)]
    line = rng.choices(words, k=30)
    texts = [" ".join(line + rng.choices(words, k=30)) for _ in range(30)]
    texts.append(texts[4] + " end")
    compared = []
    save = shingles.Workspace.save

    def seen(self, df, label, *rest):
        out = save(self, df, label, *rest)
        if label == "nearest":
            compared.append(out.count())
        return out

    monkeypatch.setattr(shingles.Workspace, "save", seen)
    found = simhash.similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == {**{i: i for i in range(30)}, 30: 4}
    assert compared == [1]


def test_shards_make_no_more_rows_than_they_have(spark, monkeypatch):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(4000)]
    base = rng.choices(words, k=100)
    texts = [" ".join([*base[:i], "x", *base[i + 1 :]]) for i in range(0, 93, 3)]
    rows_of = []
    plain = shingles._small

    def counted(shards):
        out = plain(shards)
        rows_of.append((shards.count(), out.count()))
        return out

    monkeypatch.setattr(shingles, "_small", counted)
    monkeypatch.setattr(shingles, "_frequent", lambda *_: np.zeros(0, np.uint64))
    found = simhash.similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r["component_id"] for r in found.collect()} == {0}
    ((taken, made),) = rows_of
    assert 0 < made <= taken


def test_fine_maps_tell_large_sets_apart(spark):
    hashes = np.random.default_rng(2).integers(0, 1 << 63, 4500).astype(np.uint64)
    members, offsets = np.concatenate([np.sort(hashes[:3000]), np.sort(hashes[1500:])]), np.array([0, 3000, 6000])
    for residues, kept in ((shingles.PARITIES, 1), (shingles.FINE, 0)):
        maps = shingles.parities(members, offsets, residues)
        facts = spark.createDataFrame([(i, 3000, bytearray(m.tobytes())) for i, m in enumerate(maps)], "fp long, n int, parity binary")
        assert shingles._possible(spark.createDataFrame([(0, 1)], "a long, b long"), facts, residues).count() == kept
