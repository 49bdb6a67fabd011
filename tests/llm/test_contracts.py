"""The ten queries as registered, on small tables: columns, types, folds, and facts that a plain account gives."""

import base64
import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from cadenza.llm import licenses, queries
from tests.llm.test_classifiers import corpus
from tests.llm.test_simhash import slow_components, slow_fingerprint

TYPES = {
    "op2_warc_archive": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    "op3_embedding_dedup": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op4_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op5_simhash_dedup": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op6_token_files": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op8_ppm_scores": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op9_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op10_best_fit_packing": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("contracts"))
    rng = random.Random(5)
    made = corpus(220, 11)
    docs = [(r[0], r[1], r[2], f"src{r[0] % 3}", len(r[1])) for r in made]
    docs += [(500 + i, made[i][1], made[i][2], "src0", 1) for i in range(20)]
    docs += [(600, None, None, "x", None), (601, "", "en", None, 0), (602, " 12 34 ", "en", "x", 7), (603, "Wörter " * 3000, "de", "x", 1)]
    docs += [(610, made[3][1] + "\n\nLicensed under the\nApache License,\nVersion 2.0.\n\nend", "en", "x", 1)]
    items = [(i, " ".join("".join(rng.choices("bcdfgklmn", k=5)) for _ in range(12))) for i in range(3)]
    docs += [(620 + i, f"{made[i][1]} {items[i][1]}", "en", "x", 1) for i in range(3)]
    vectors = np.random.default_rng(2).normal(size=(60, 16))
    vectors[20:40] = vectors[:20] + np.random.default_rng(3).normal(size=(20, 16)) * 0.1
    pages = [(i, f"http://h/{i}", "<p>same</p>" if i % 3 == 0 else f"<p>{i}</p>") for i in range(30)] + [(30, None, None), (31, "u", "")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(r[0], 1, r[5]) for r in made], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{where}/pages.parquet")
    spark.createDataFrame([(i, [float(x) for x in v], 0) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int").write.parquet(f"{where}/embeddings.parquet")
    return where, {d[0]: d for d in docs}, made, pages, vectors


@pytest.fixture(scope="module")
def run(spark, tables):
    def one(name):
        found = queries.QUERIES[name](spark, tables[0])
        assert {k: dict(found.dtypes).get(k) for k in TYPES.get(name, {})} == TYPES.get(name, {})
        return found.collect()

    return one


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_agrees(spark, tables, run, name):
    duck = duckdb.connect()
    for table in ("pages", "embeddings"):
        duck.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tables[0]}/{table}.parquet/*.parquet'")
    expected = duck.sql(queries.ORACLES[name])
    found = [tuple(r[c] for c in expected.columns) for r in run(name)]
    assert sorted(found, key=repr) == sorted(expected.fetchall(), key=repr)


def fold(i):
    return zlib.crc32(str(i).encode()) % 5


def test_op1(run, tables):
    found = {r["doc_id"]: r for r in run("op1_license_scan")}
    assert set(found) == set(tables[1]) and found[610]["families"] == "apache-2.0" and found[610]["n_licensed"] == 1
    assert all(r["n_licensed"] == 0 for i, r in found.items() if i != 610) and "apache-2.0" in licenses.TEMPLATES


def test_op2(run, tables):
    largest = {}
    for i, _, html in tables[3]:
        largest[html or ""] = max(largest.get(html or "", i), i)
    expected = set()
    for i, _, html in tables[3]:
        raw, top = (html or "").encode(), largest[html or ""]
        expected.add((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if i == top else "revisit", None if i == top else top))
    assert {(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in run("op2_warc_archive")} == expected


def test_op3(run, tables):
    unit = tables[4].astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.9) & ~np.eye(len(unit), dtype=bool)
    assert links.sum() >= 30
    found = {r["vec_id"]: r for r in run("op3_embedding_dedup")}
    assert [found[i]["n_links"] for i in range(60)] == links.sum(axis=1).tolist()
    assert all(r["kept"] == (i == r["component_id"]) for i, r in found.items()) and all(found[i]["component_id"] == found[i + 20]["component_id"] for i in range(20) if links[i, i + 20])


def test_op4(run, tables):
    found = {r["doc_id"]: r for r in run("op4_language_id")}
    assert set(found) == set(tables[1]) and all(r["held_out"] == (fold(i) == 0) and 0 <= r["score"] <= 1 for i, r in found.items())
    assert {found[i]["lang_pred"] for i in (600, 601, 602)} == {"und"}
    assert np.mean([found[r[0]]["lang_pred"] == r[2] for r in tables[2]]) > 0.95


def test_op5(run, tables):
    found = {r["doc_id"]: r for r in run("op5_simhash_dedup")}
    ids = sorted(found)
    prints = [slow_fingerprint(tables[1][i][1]) for i in ids]
    assert [found[i]["fingerprint"] for i in ids] == [f"{p:016x}" for p in prints]
    assert [found[i]["component_id"] for i in ids] == slow_components(ids, prints) and xxhash.xxh64_intdigest(b"", 42) > 0


def ids_of(text, end):
    return [*Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text or "", add_special_tokens=False).ids, end]


def test_op6(run, tables):
    found = {r["doc_id"]: r for r in run("op6_token_files")}
    start = 0
    for i in sorted(tables[1]):
        ids = ids_of(tables[1][i][1], 2)
        assert (found[i]["start"], found[i]["n_tokens"], found[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_op7(run, tables):
    found = {r["doc_id"]: r for r in run("op7_decontamination")}
    assert set(found) == set(tables[1]) and {i for i, r in found.items() if r["contaminated"]} == {620, 621, 622}
    assert [found[620 + i]["items"] for i in range(3)] == ["0", "1", "2"] and found[620]["least_distance"] == 0


def test_op8(run, tables):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()
    counts = {}
    for i, d in tables[1].items():
        if fold(i) != 1:
            for w in [*low(d[1]), None]:
                counts[w] = counts.get(w, 0) + 1
    total, distinct = sum(counts.values()), len(counts)
    for r in run("op8_ppm_scores"):
        tokens = [*low(tables[1][r["doc_id"]][1]), None]
        base = sum(math.log10((counts.get(w, 0) + 0.5) / (total + 0.5 * (distinct + 1))) for w in tokens)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (fold(r["doc_id"]) == 1, len(tokens), sum(w in counts for w in tokens), total)
        assert r["base_score"] == pytest.approx(base) and r["score"] < 0


def test_op9(run, tables):
    found = {r["doc_id"]: r for r in run("op9_toxicity")}
    assert set(found) == set(tables[1]) and all(r["held_out"] == (fold(i) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for i, r in found.items())
    assert np.mean([found[r[0]]["predicted"] == r[5] for r in tables[2]]) > 0.9


def test_op10(run, tables):
    pieces, spots = {}, {}
    for r in run("op10_best_fit_packing"):
        pieces.setdefault(r["doc_id"], []).append(r)
        spots.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, d in tables[1].items():
        ids, at = ids_of(d[1], 0), 0
        for k, r in enumerate(sorted(pieces.pop(i), key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at) and r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes()) and (r["length"] == 2048 or k == 0 or at + r["length"] == len(ids))
            at += r["length"]
        assert at == len(ids)
    assert not pieces
    for held in spots.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
