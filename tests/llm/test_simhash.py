import random
import re

import xxhash

from cadenza.llm import simhash
from cadenza.llm.graph import connected_components
from cadenza.llm.workspace import Workspace
from tests.llm.helpers import AWKWARD, awkward, empty, rows


def slow_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    out = 0
    for bit in range(64):
        if 2 * sum(xxhash.xxh64_intdigest(s.encode(), 42) >> bit & 1 for s in shingles) > len(shingles):
            out |= 1 << bit
    return out


def slow_components(ids, prints):
    component = list(range(len(ids)))
    changed = True
    while changed:
        changed = False
        for i in range(len(ids)):
            for j in range(len(ids)):
                if (prints[i] ^ prints[j]).bit_count() <= 2 and component[j] < component[i]:
                    component[i] = component[j]
                    changed = True
    best = {}
    for i, c in enumerate(component):
        if ids[i] is not None:
            best[c] = min(best.get(c, ids[i]), ids[i])
    return [best.get(c) for c in component]


def test_awkward_rows_match_brute_force(spark):
    for extra in (False, True):
        prints = [slow_fingerprint(r[1]) for r in AWKWARD]
        expected = sorted(zip([r[0] for r in AWKWARD], prints, slow_components([r[0] for r in AWKWARD], prints)), key=repr)
        found = [(i, fp % 2**64, c) for i, fp, c in simhash.near_duplicates(awkward(spark, extra)).collect()]
        assert sorted(found, key=repr) == [tuple(x) for x in expected]


def test_empty(spark):
    assert rows(simhash.near_duplicates(empty(spark))) == []


def test_links_match_all_pairs_with_and_without_large_shards(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(60)] + [0, 2**64 - 1]
    fps = set(base)
    for b in base[:30]:
        for _ in range(12):
            for bit in rng.sample(range(64), rng.choice([1, 2, 3])):
                b ^= 1 << bit
            fps.add(b)
    fps = sorted(fps)
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    expected = slow_components([signed(x) for x in fps], fps)
    for limit in (10_000, 3):
        ws = Workspace(spark, "t")
        edges = simhash.link_fingerprints(ws, spark.createDataFrame([(signed(x),) for x in fps], "fp long"), limit=limit)
        found = {r["node"]: r["component"] for r in connected_components(ws, edges).collect()}
        assert [found.get(signed(x), signed(x)) for x in fps] == expected


def test_bk_tree_finds_what_a_scan_finds():
    rng = random.Random(2)
    values = list({rng.getrandbits(12) for _ in range(300)})
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for q in range(0, 4096, 37):
        assert sorted(values[i] for i in tree.within(q, 2)) == sorted(v for v in values if (v ^ q).bit_count() <= 2)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in range(101, 130)] + [(200, 200)]
    found = dict(rows(connected_components(Workspace(spark, "t"), spark.createDataFrame(edges, "a long, b long"))))
    assert found == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}}
