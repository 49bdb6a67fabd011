import hashlib
import base64
import math
import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cadenza.llm import decontam, embed_dedup, ppm, warc
from tests.llm.helpers import AWKWARD, awkward, empty, rows

PAGES = "page_id long, url string, html string"
ROWS = [(1, "http://a", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://c", None), (4, "http://d", ""), (5, "http://e", "x\r\n\r\nWARC/1.1\r\n"), (5, "http://e", "x\r\n\r\nWARC/1.1\r\n"), (None, "n", "only"), (None, "n", "<p>é</p>"), (9, "http://\nline", "y" * 100_000)]


def test_warc_index_matches_a_plain_account(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ROWS, PAGES).withColumn("payload", F.lit(1)).withColumn("digest", F.lit(1)).withColumn("response", F.lit(1))
    largest = {}
    for page, _, html in ROWS:
        body = html or ""
        if page is not None:
            largest[body] = max(largest.get(body, page), page)
    expected = []
    for page, _, html in ROWS:
        raw, top = (html or "").encode(), largest.get(html or "")
        sha = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        response = top is None or page == top
        expected.append((page, len(raw), sha, "response" if response else "revisit", None if response else top))
    assert rows(warc.round_trip(df)) == sorted(expected, key=repr)
    assert rows(warc.round_trip(spark.createDataFrame([], PAGES))) == []


def test_hostile_urls_do_not_forge_fields(spark):
    breaks = ["\r\n", "\n", "\r", "\u2028", "\u2029", "\x85", "\v", "\f", "\x1c", "\x1d", "\x1e"]
    urls = [f"http://a{b}WARC-Page-ID: 77{b}WARC-Type: revisit{b}{b}x" for b in breaks]
    df = spark.createDataFrame([(i, u, f"page {i}") for i, u in enumerate(urls)], PAGES)
    assert [r[:2] + r[3:] for r in rows(warc.round_trip(df))] == sorted([(i, len(f"page {i}"), "response", None) for i in range(len(urls))], key=lambda r: repr((r[0],)))


def test_warc_files_rebuild_records(spark, tmp_path):
    df = spark.createDataFrame(ROWS, PAGES)
    warc.write(df, f"{tmp_path}/a")
    warc.export(spark, f"{tmp_path}/a", f"{tmp_path}/files")
    rebuilt = {(r["header"], bytes(r["block"])) for r in warc.records(spark, f"{tmp_path}/a").collect()}
    read = [(r["header"], bytes(r["block"])) for r in warc.read_files(spark, f"{tmp_path}/files").collect()]
    assert len(read) == len(ROWS) and set(read) == rebuilt
    assert spark.read.parquet(f"{tmp_path}/a/payloads").count() == len({r[2] or "" for r in ROWS})


def test_a_changed_payload_is_noticed(spark, tmp_path):
    warc.write(spark.createDataFrame(ROWS[:2], PAGES), f"{tmp_path}/a")
    from pyspark.sql import functions as F

    stored = spark.read.parquet(f"{tmp_path}/a/payloads").withColumn("payload", F.lit(b"other"))
    stored.write.parquet(f"{tmp_path}/b")
    (tmp_path / "a" / "payloads").rename(tmp_path / "old")
    (tmp_path / "b").rename(tmp_path / "a" / "payloads")
    with pytest.raises(Exception, match="does not match"):
        warc.index(spark, f"{tmp_path}/a").collect()


def plain_groups(ids, vectors, threshold):
    sound = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for v in vectors]
    unit = [np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) if s else None for v, s in zip(vectors, sound)]
    n = len(ids)
    links = [[j for j in range(n) if j != i and sound[i] and sound[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold] for i in range(n)]
    out = []
    for i in range(n):
        seen, stack = {i}, [i]
        while stack:
            for j in links[stack.pop()]:
                if j not in seen:
                    seen.add(j)
                    stack.append(j)
        named = [ids[j] for j in seen if ids[j] is not None]
        component = min(named) if named else None
        out.append((ids[i], len(links[i]), component, ids[i] == component))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("bucket", "split"), [(512, 4096), (16, 4096), (64, 20)])
def test_embedding_groups_match_all_pairs(spark, bucket, split):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 24))
    vectors = [list(map(float, v)) for v in base]
    for k in range(120):
        v = base[k % 12] + rng.normal(size=24) * rng.choice([0.05, 0.2, 0.3, 0.45])
        vectors.append(list(map(float, v)))
    vectors += [vectors[0]] * 5 + [None, [], [0.0] * 24, [float("nan")] * 24, [float("inf")] + [1.0] * 23, [None] + [1.0] * 23, [1.0, 2.0], [2.0, 4.0]]
    ids = list(range(len(vectors)))
    ids[3], ids[70] = None, 12
    df = spark.createDataFrame(list(zip(ids, vectors)), "vec_id long, embedding array<float>")
    from pyspark.sql import functions as F

    df = df.withColumn("class", F.lit(1)).withColumn("vector", F.lit(1)).withColumn("n", F.lit(1))
    found = rows(embed_dedup.near_duplicates(df, miss=1e-9, bucket=bucket, split=split))
    assert found == plain_groups(ids, vectors, 0.9)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_long_vectors_and_recall_at_the_default_miss(spark, kind):
    rng = np.random.default_rng(5)
    vectors = []
    for dim in (100, 255, 256, 384, 768, 1024):
        base = rng.normal(size=(25, dim))
        near = base[rng.integers(0, 25, 60)] + rng.normal(size=(60, dim)) * rng.choice([0.1, 0.3, 0.45, 0.48], 60)[:, None]
        vectors += [list(map(float, v)) for v in (*base, *near)]
    if kind == "double":
        vectors = [[x * 1e60 for x in v] for v in vectors]
    df = spark.createDataFrame(list(enumerate(vectors)), f"vec_id long, embedding array<{kind}>")
    found = embed_dedup.near_duplicates(df, bucket=16).collect()
    unit = [np.array(v, np.float32 if kind == "float" else float).astype(float) for v in vectors]
    unit = [u / np.abs(u).max() for u in unit]
    unit = [u / np.linalg.norm(u) for u in unit]
    links = [sum(len(u) == len(w) and i != j and u @ w >= 0.9 for j, w in enumerate(unit)) for i, u in enumerate(unit)]
    assert sum(links) > 300
    counted = {r["vec_id"]: r["n_links"] for r in found}
    assert all(counted[i] <= n for i, n in enumerate(links)) and sum(counted.values()) >= 0.99 * sum(links)


def test_no_embeddings(spark):
    assert rows(embed_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>"))) == []


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    codes = embed_dedup.Codes(64)
    estimate, width = codes.estimate(*codes.encode(x), *codes.planes(x, 0))
    error = (estimate - x @ x.T)[~np.eye(600, dtype=bool)]
    assert abs(error.mean()) < 0.005 and (np.abs(error) > width[~np.eye(600, dtype=bool)]).mean() < 1e-3


def slow_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_myers_matches_the_table():
    rng = random.Random(0)
    for _ in range(300):
        pattern, text = "".join(rng.choices("abc", k=rng.randint(1, 80))), "".join(rng.choices("abc", k=rng.randint(0, 100)))
        distance, end = decontam.myers(pattern, text)
        assert distance == slow_distance(pattern, text)
        assert distance == min(len(pattern), slow_distance(pattern, text[:end]))


def test_passages_within_the_budget_are_found(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8)))
    items = [(i, " ".join(word() for _ in range(30))) for i in range(12)] + [(99, None), (98, "")]
    docs, expected = [], {}
    for i in range(80):
        body = [word() for _ in range(100)]
        text = " ".join(body)
        if i % 2:
            n = rng.randrange(12)
            passage = list(items[n][1].upper() if i % 4 == 1 else items[n][1])
            for _ in range(rng.randint(0, 14)):
                at = rng.randrange(len(passage))
                passage[at] = rng.choice(["", "z", passage[at] + "q"])
            text = " ".join(body[:50]) + "  " + "".join(passage) + "\n" + " ".join(body[50:])
        docs.append((i, text))
    plain = {}
    for i, text in docs:
        plain[i] = sorted(n for n, t in items if t and slow_distance(decontam.normal(t), decontam.normal(text)) <= math.floor(0.05 * len(decontam.normal(t))))
    assert sum(map(bool, plain.values())) > 20
    df, wanted = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for chars in (4_000_000, 500):
        for r in decontam.find(df, wanted, item_chars=chars).collect():
            assert sorted({m["item_id"] for m in r["matches"]}) == plain[r["doc_id"]]
            for m in r["matches"]:
                found = decontam.normal(r["text"])[m["start"] : m["end"]]
                assert slow_distance(decontam.normal(dict(items)[m["item_id"]]), found) == m["distance"]


def test_a_text_that_repeats_an_item_is_linear(spark):
    item = "the quick brown fox jumps over the lazy dog and runs away again"
    text = " ".join([item] * 4000)
    began = time.perf_counter()
    found = decontam.Matcher([(1, item), (2, "lazy dog and runs")], 0.05).matches(text)
    assert sum(m[0] == 1 for m in found) == 4000 and all(m[3] == 0 for m in found) and time.perf_counter() - began < 20
    docs = spark.createDataFrame([(1, text, 7, 0), (2, "plain", 8, 0), (2, "plain", 8, 0)], "doc_id long, text string, _row long, row int")
    items = spark.createDataFrame([(i, f"{item} {i}") for i in range(5)] + [(9, item)], "item_id long, text string")
    one, many = (decontam.find(docs, items, item_chars=c) for c in (4_000_000, 100))
    assert one.columns == many.columns == [*docs.columns, "matches"]
    plain = lambda df: sorted((r["doc_id"], r["_row"], sorted(map(tuple, r["matches"]))) for r in df.collect())
    assert plain(one) == plain(many)


def test_decontamination_of_awkward_rows(spark):
    items = spark.createDataFrame([(1, "the cat sat on the mat"), (1, "the cat sat on the mat"), (None, "a row without")], "item_id long, text string")
    found = decontam.find(awkward(spark, True), items).collect()
    assert len(found) == len(AWKWARD)
    assert sorted(r["doc_id"] for r in found if r["matches"] and r["doc_id"] is not None) == [3, 4, 4]
    assert decontam.find(empty(spark), items).count() == 0
    assert all(r["matches"] in ([], None) for r in decontam.find(awkward(spark), items.limit(0)).collect())


def slow_ppm(texts, order):
    """Counts by context: how often for the longest, behind how many bytes for shorter ones."""
    full = Counter()
    for text in texts:
        data = b"\n" * order + b" ".join(text.lower().encode().split()) + b"\n"
        full.update(data[i - order : i + 1] for i in range(order, len(data)))
    levels = {order: full}
    for k in range(order - 1, -1, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    cut = {k: ppm.discount(sum(c == 1 for c in v.values()), sum(c == 2 for c in v.values())) for k, v in levels.items()}

    def probability(context, symbol):
        p, out = 1.0, set()
        for k in range(order, -1, -1):
            seen = {g[-1]: c for g, c in levels[k].items() if g[:-1] == context[order - k :]}
            if not seen:
                continue
            open_ = {s: c for s, c in seen.items() if s not in out}
            total = sum(open_.values())
            if symbol in open_:
                return p * (open_[symbol] - cut[k]) / total
            if open_:
                p *= cut[k] * len(open_) / total
            out |= set(seen)
        return p / (ppm.ALPHABET - len(out))

    return probability


def test_scores_match_brute_force(spark):
    learn = ["the cat sat on the mat", "a cat and a hat", "The Dog ate the CAT", "", None, "hat hat hat"]
    score = ["the cat ate the hat", "zebra!", "", None, "été the", "the\t cat\n"]
    order = 3
    docs = spark.createDataFrame(list(enumerate(score)), "doc_id long, text string")
    source = spark.createDataFrame(list(enumerate(learn)), "doc_id long, text string")
    probability = slow_ppm([t or "" for t in learn], order)
    low = lambda t: (t or "").lower().split()
    counts = Counter(w for t in learn for w in [*low(t), None])
    total, distinct = sum(counts.values()), len(counts)
    for head, most, whole in ((200_000, 400_000, 500_000), (2, 5, 0), (2, 0, 500_000)):
        for r in ppm.score(docs, source, order=order, head_words=head, most=most, low_grams=whole).collect():
            data = b"\n" * order + " ".join(low(score[r["doc_id"]])).encode() + b"\n"
            expected = sum(math.log10(probability(data[i - order : i], data[i])) for i in range(order, len(data)))
            tokens = [*low(score[r["doc_id"]]), None]
            base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in tokens)
            assert r["score"] == pytest.approx(expected) and r["base_score"] == pytest.approx(base)
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(counts[w] > 0 for w in tokens), total)


def test_probabilities_sum_to_one(spark):
    from cadenza.llm.workspace import Workspace

    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["the cat sat on the mat and the dog sat on the log", "a cat and a hat"] * 3)], "doc_id long, text string")
    for most in (10, 1000):
        model = ppm.build(Workspace(spark, "t"), ppm.count(docs, order=3), 3, most)
        trie = ppm.Trie([ppm._columns(x) for x in model.levels], model.discounts)
        assert len(model.head[0]) <= most and model.head[1] == pytest.approx(trie.log10_each(model.head[0]))
        values = [b for b in range(256) if b not in (9, 11, 12, 13)]
        for context in (b"the", b"at ", b"\n\n\n", b"zzz", b"zth"):
            keys = np.array([int.from_bytes(context + bytes([b]), "big") for b in values], np.uint64)
            assert (10 ** trie.log10_each(keys)).sum() == pytest.approx(1)


def test_adaptive_probabilities_sum_to_one_and_improve_on_repeats(spark):
    model = ppm.Adaptive(3)
    text = "the cat sat on the mat"
    first = model.log10(text)
    assert model.log10(text) > first / 2
    values = [b for b in range(256) if b not in (9, 11, 12, 13)]
    assert sum(model.probability(b"the", b) for b in values) == pytest.approx(1)
    found = dict(rows(ppm.score_adaptive(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), order=3)))
    assert found[1] == pytest.approx(first) and found[2] < 0


def test_scores_of_awkward_rows(spark):
    found = ppm.score(awkward(spark, True), ppm.learned(awkward(spark))).collect()
    assert len(found) == len(AWKWARD) and all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in found)
    assert ppm.score(empty(spark), awkward(spark)).count() == 0
    blank = ppm.score(awkward(spark), empty(spark)).collect()
    assert all(r["n_known"] == 0 and abs(r["base_score"]) < 1e-6 for r in blank)


def test_slices_keep_their_own_texts():
    from cadenza.llm.arrowtext import slices, texts_of

    texts = ["Héé ONE two", None, "ÉÇ deux\tTrois ", "  x é Y", "zz"] * 5
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split()
    found = [[w for w in ws if w] for s in slices([batch], "text", 20) for ws in ppm.split(texts_of(s, "text")).to_pylist()]
    assert found == [low(t) for t in texts]


def test_look_ups_find_all_and_only_their_keys():
    rng = np.random.default_rng(0)
    keys = rng.choice(10_000, 3000, replace=False).astype(np.uint64)
    table = ppm.Lookup(keys)
    found = table.find(np.arange(10_000, dtype=np.uint64))
    assert (found[keys.astype(int)] == np.arange(3000)).all() and (found >= 0).sum() == 3000
