"""The pipeline: each stage's decisions against plain Python, and the whole run."""

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_copies import brute
from tests.llm.test_text_operators import brute_hits
from tidemark.llm.common import read

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    where, docs, out = tmp_path_factory.mktemp("stages"), read(spark, SF, "documents"), {"documents": None}
    out["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{where}/{name}")
        out[name] = docs = spark.read.parquet(f"{where}/{name}")
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns(stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert all(stages[n].columns == stages["documents"].columns for n in names[:-1]) and {"shard", "slot"} <= set(stages[names[-1]].columns)


def test_language_keeps_clean_documents(stages):
    before, after = texts(stages["documents"]), texts(stages["language"])
    assert after.items() <= before.items() and len(after) >= 0.95 * len(before)


def test_one_of_each_group(stages):
    before, after = texts(stages["language"]), texts(stages["near_copies"])
    assert set(after) == {k for k, v in brute(before)[1].items() if k == v}


def test_no_benchmark_passage_is_left(stages):
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    before, after = texts(stages["near_copies"]), texts(stages["decontamination"])
    assert set(before) == set(after)
    dirty = {k for k, (_, hit, _) in zip(before, brute_hits(before.values(), items), strict=True) if hit}
    assert dirty and not any(hit for _, hit, _ in brute_hits(after.values(), items))
    assert {k for k in before if before[k] != after[k]} == dirty
    assert all(r.n_chars == len(r.text) for r in stages["decontamination"].collect())


def test_mixing_and_shards(stages):
    before, after = texts(stages["decontamination"]), texts(stages["mixing"])
    assert after.items() <= before.items()
    last = stages["sharding"].collect()
    assert len(last) == stages["mixing"].count() and len({(r.shard, r.slot) for r in last}) == len(last)


def test_run(spark, stages):
    assert corpus_pipeline.run(spark, SF).count() == stages["sharding"].count()


def test_stages_on_odd_tables(spark, tmp_path, tiny, nothing):
    """NULLs in any column, empty and repeated rows, clashing names, and tables without rows."""
    odd = tiny.withColumn("source", F.lit(None).cast("string")).withColumn("size", F.lit(1)).withColumn("slot", F.col("doc_id")).withColumn("th", F.lit("x"))
    bench = spark.createDataFrame([(1, "the lazy dog and runs far"), (2, None)], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, None), (None, None, 1)], "doc_id long, quality int, toxic int")
    for case, (docs, b, y) in enumerate([(odd, bench, labels), (odd, bench.where("false"), labels.where("false")), (odd.where("false"), bench, labels)]):
        where = f"{tmp_path}/{case}"
        docs.write.parquet(f"{where}/documents.parquet")
        b.write.parquet(f"{where}/benchmark.parquet")
        y.write.parquet(f"{where}/labels.parquet")
        now = read(spark, where, "documents")
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, now, where)
            out.write.parquet(f"{where}/{name}")
            now = spark.read.parquet(f"{where}/{name}")
            assert now.columns == docs.columns or i == len(corpus_pipeline.STAGES) - 1
        assert {"shard", "source_size", "source_slot", "text", "th"} <= set(now.columns)
        assert now.count() == corpus_pipeline.run(spark, where).count()
        if case == 2:
            assert now.count() == 0
        if case == 0:
            left = [r.text for r in spark.read.parquet(f"{where}/decontamination").collect()]
            assert len(left) == len(set(left)) and not any("lazy dog" in t for t in left)
