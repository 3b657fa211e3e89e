"""The pipeline's stages one by one on a small corpus, and as a whole."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from tests.llm.test_llm import brute_hits, brute_mix, brute_similar, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    rng = random.Random(11)
    rows = [(i, words(rng, 100), "en", rng.choice("ab"), 0) for i in range(60)]
    rows += [(60 + i, rows[i][1], "en", "b", 0) for i in range(6)] + [(70, "你好" * 60, None, "a", 0), (71, None, "en", "a", 0)]
    rows += [(80 + i, rows[20 + i][1] + " more", "en", "a", 0) for i in range(10)]
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, " ".join(rows[9][1].split()[5:30])), (2, "x y z")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = {r[0]: tuple(r) for r in docs.collect()}
    want = set(rows) - {70, 71}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        docs.write.parquet(f"{sf}/out-{name}")
        docs = spark.read.parquet(f"{sf}/out-{name}")
        got = Counter(r["doc_id"] for r in docs.collect())
        if name == "near_dedup":
            want = set(brute_similar([(d, rows[d][1]) for d in want]).values())
            assert not want & set(range(60, 67)) and not want & set(range(80, 90))
        elif name == "decontamination":
            want = {d for d in want if not brute_hits(rows[d][1], items)[-1]}
        elif name == "mixing":
            before = [rows[d] for d in sorted(want)]
            size, total, target = brute_mix(before)
            assert all(n <= 2 for n in got.values()) and set(got) <= want
            for s in total:
                taken = sum(n * len(rows[d][1].split()) for d, n in got.items() if rows[d][3] == s)
                assert 0 <= taken - target[s] < 100
            continue
        if name == "sharding":
            assert set(docs.columns) == {"doc_id", "text", "lang", "source", "n_chars", "shard", "slot", "grown_shard"}
        else:
            assert set(got) == want and docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name


def test_an_empty_table_goes_through(spark, sf, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_run_equals_stages(spark, sf):
    assert sorted(map(str, corpus_pipeline.run(spark, sf).drop("slot").collect())) == sorted(map(str, spark.read.parquet(f"{sf}/out-sharding").drop("slot").collect()))
