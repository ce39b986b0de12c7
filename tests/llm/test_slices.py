"""Bounded batches: no row is lost, whatever is long, wide or empty; hot keys of samples."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, edit_fingerprint, jaccard_join, language_id, mixing, sharding, toxicity


def batches(rows: int, text: str | None, wide: int = 0, each: int = 1000):
    for begin in range(0, rows, each):
        n = min(each, rows - begin)
        yield pa.record_batch({"id": pa.array(range(begin, begin + n)), "text": pa.array([text] * n, pa.string()), "wide": pa.array(["w" * wide] * n)})


@pytest.mark.parametrize("cut", [common.slices, common.gathered])
@pytest.mark.parametrize(("rows", "text", "wide"), [(300, None, 1_000_000), (300, "some text", 400_000), (100_000, None, 0), (100_000, "a", 0), (50, "t" * 100_000, 0), (0, "", 0)])
def test_every_row_comes_once_in_bounded_batches(cut, rows, text, wide):
    seen = []
    for part in cut(batches(rows, text, wide)):
        assert part.num_rows <= common.SLICE_ROWS
        assert part.num_rows == 1 or part.nbytes <= common.SLICE_BYTES
        assert part.num_rows == 1 or len(text or "") * part.num_rows <= common.SLICE_CHARS
        seen += part.column("id").to_pylist()
    assert seen == list(range(rows))


def test_one_row_beyond_every_bound_is_a_batch_of_its_own():
    rows = pa.record_batch({"id": pa.array([1, 2, 3]), "text": pa.array(["a", "b" * 5_000_000, "c"]), "wide": pa.array(["x", "y" * 40_000_000, "z"])})
    assert [p.column("id").to_pylist() for p in common.gathered(iter([rows]))] == [[1], [2], [3]]


def test_wide_columns_pass_through_the_stages_that_filter(spark):
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit("en").alias("lang"), F.repeat(F.lit("w"), 1_000_000).alias("body")).coalesce(1)
    docs = docs.withColumn("text", F.expr("CASE WHEN doc_id % 2 = 0 THEN 'some english words here' END"))
    kept = language_id.drop_rejected(docs, language_id.learn(docs))
    assert sorted((r.doc_id, r.n) for r in kept.select("doc_id", F.length("body").alias("n")).collect()) == [(i, 1_000_000) for i in range(0, 60, 2)]


def test_many_empty_and_short_texts_in_one_partition(spark):
    n = 60_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.expr("CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN '' ELSE 'a' END").alias("text")).coalesce(1)
    assert edit_fingerprint.fingerprint(docs).count() == n
    found = jaccard_join.near_classes(docs)
    assert found.count() == n
    assert found.where("n_links > 0").agg(F.count(F.lit(1)), F.min("n_links")).first() == (n // 3, n // 3 - 1)


def test_rows_without_a_key_are_sampled_like_others(spark):
    docs = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("number "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    many = docs.unionByName(docs.limit(1).crossJoin(spark.range(5000)).select("doc_id", "text", "lang"))
    learned = language_id.learn(many, per_language=50)
    words = learned["en"].decode().split()
    assert len(words) == 50


def test_labelled_keys_that_repeat_bring_one_row(spark):
    docs = spark.createDataFrame([(1, f"you idiot {i}") for i in range(300)] + [(i, f"a fine day {i}") for i in range(2, 60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 20)) for i in range(1, 60)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    again = toxicity.learn(docs.dropDuplicates(["doc_id"]).where("doc_id > 1").unionByName(spark.createDataFrame([(1, "you idiot 0")], docs.schema)), labels)
    assert model.constant == again.constant and model.lexicon == again.lexicon
    learned = mixing.learn(docs, labels.select("doc_id", F.when(F.col("toxic") == 1, "poor").otherwise("good").alias("domain")), ["good", "poor"])
    assert learned.priors == [41 / 61, 20 / 61]


def test_kept_columns_never_share_a_name(spark):
    docs = spark.createDataFrame([(1, "a", 5, "x", "y")], "doc_id long, text string, size int, source_size string, source_source_size string")
    out = sharding.shard(docs, keep=[c for c in docs.columns if c != "doc_id"])
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    row = out.first()
    assert (row["size"], row["source_size"], row["source_source_size"], row["source_source_source_size"]) == (17, "x", "y", 5)
