"""The pipeline's stages against plain versions of their decisions on a small corpus."""

import random

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cadenza.llm import decontam, langid
from tests.llm.test_classifiers import corpus
from tests.llm.test_shingles import slow_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(0)
    made = corpus(300, 3)
    rows = [(r[0], r[1], r[2], "s", 0) for r in made]
    labels = [(r[0], 1, r[5]) for r in made]
    items = [(i, " ".join("".join(rng.choices("bcdfgklmn", k=5)) for _ in range(12))) for i in range(3)]
    rows += [(1000 + i, rows[i][1], rows[i][2], "copy", 0) for i in range(40)]
    rows += [(2000 + i, rows[50 + i][1] + " " + items[i % 3][1], rows[50 + i][2], "leak", 0) for i in range(6)]
    rows += [(3000, None, "en", "x", 0), (3001, "123 456", "en", "x", 0), (3002, "", None, "x", 0)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return where, rows, items


def test_each_stage_decides_as_its_plain_version(spark, folder):
    where, rows, items = folder
    docs = spark.read.parquet(f"{where}/documents.parquet")
    named = dict(corpus_pipeline.STAGES)
    kept = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())

    after = named["language_id"](spark, docs, where)
    assert after.columns == docs.columns
    lettered = {r[0] for r in rows if any(c.isalpha() for c in r[1] or "")}
    assert set(kept(after)) <= lettered and len(kept(after)) >= 0.98 * len(lettered)

    clean = named["toxicity"](spark, after, where)
    held = {r["doc_id"]: r["text"] for r in after.collect()}
    insult = {i for i, t in held.items() if {"zorp", "blarg", "fnord"} & set(t.split())}
    assert clean.columns == docs.columns
    left = set(kept(clean))
    assert len(left & insult) <= 0.1 * len(insult) and len(left - insult) >= 0.95 * len(set(held) - insult)

    base = clean.collect()
    base.sort(key=lambda r: r["doc_id"])
    ids = [r["doc_id"] for r in base]
    expected = [ids[i] for i, c in enumerate(slow_components([r["text"] for r in base])) if i == c]
    assert len(expected) < len(ids)
    fixed = spark.createDataFrame(base, docs.schema)
    single = named["simhash_dedup"](spark, fixed, where)
    assert kept(single) == expected and single.columns == docs.columns

    safe = named["decontamination"](spark, fixed, where)
    holds = {r["doc_id"] for r in base if any(decontam.normal(t) in decontam.normal(r["text"]) for _, t in items)}
    assert holds and set(kept(safe)) == set(ids) - holds

    packed = named["packing"](spark, fixed, where).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lengths = {r["doc_id"]: len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1 for r in base}
    assert {r["doc_id"]: r["length"] for r in packed} == lengths
    fill = {}
    for r in packed:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    assert max(fill.values()) <= 2048 and len(fill) <= np.ceil(sum(lengths.values()) / 2048) + 1


def test_run_chains_all_stages(spark, folder):
    where, rows, _ = folder
    found = corpus_pipeline.run(spark, where)
    ids = {r["doc_id"] for r in found.collect()}
    assert ids and not ids & {3000, 3001, 3002} and not any(2000 <= i < 2006 for i in ids) and not any(1000 <= i < 1040 for i in ids)
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES][0] == "language_id"


def test_pipeline_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert langid.UNKNOWN == "und"
