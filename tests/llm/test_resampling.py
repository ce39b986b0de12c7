"""Resampling against sums over written-out runs of words, and against its SQL."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import resampling


def plain(docs, target, run=1, buckets=10_000, seed=2024, percent=10, least=20):
    """docs: (key, text) pairs."""

    def features(text):
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
        return words, [" ".join(words[i : i + k]) for k in range(1, run + 1) for i in range(len(words) - k + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in texts for f in features(x)[1]) for texts in ([x for _, x in docs], target))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (s.total() + buckets) / ((s[b] + 1.0) * (t.total() + buckets))))
    rows = []
    for key, text in docs:
        words, found = features(text)
        weight = sum(gain(bucket(f)) for f in found)
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append([key, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(able[: len(able) * percent // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def told(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_query_against_plain_and_sql(spark, sf_dir):
    got = told(resampling.op13_resampling(spark, sf_dir))
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    assert got == plain([(r.doc_id, r.text) for r in docs], [r.text for r in items])
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    sql = con.execute(f"SELECT doc_id, n_features, weight, score, rank FROM ({resampling.ORACLE})").fetchall()
    assert got == sorted(sql, key=str)


ODD = [
    (1, "The the THE quick-brown fox 12 " * 6), (2, None), (3, ""), (4, "!!! ..."), (None, "words without a key " * 9), (5, "Ünï ünï ÜNÏ 日本 日本語 " * 5),
    (6, "same text " * 15), (6, "same text " * 15), (7, "same text " * 15), (8, "one"), (9, "\x00a\x00b c_d " * 10), (None, None), (10, "w " * 400_000),
]


@pytest.mark.parametrize("run", [1, 2, 3])
def test_odd_texts_and_longer_runs(spark, run, monkeypatch):
    docs = spark.createDataFrame([(*r, "kept", 5) for r in ODD], "doc_id long, text string, score string, _row int").repartition(3)
    target = spark.createDataFrame([("the quick brown fox",), ("same text",), (None,), ("日本 語",)], "text string")
    want = plain(ODD, [r.text for r in target.collect()], run, 50, 7, 50)
    assert told(resampling.resample(docs, target, run=run, buckets=50, seed=7, percent=50)) == want
    kept = resampling.drawn(docs, target, run=run, buckets=50, seed=7, percent=50)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in want if r[4])
    monkeypatch.setattr(resampling, "MOST_NODES", 2)
    trie, sums = resampling.Trie(run, 50), Counter()
    for _, t in ODD[:-1]:
        trie.add(resampling.words_of(t))
        if trie.nodes > resampling.MOST_NODES:
            sums.update(dict(zip(*[x.tolist() for x in trie.totals()], strict=True)))
            trie = resampling.Trie(run, 50)
    sums.update(dict(zip(*[x.tolist() for x in trie.totals()], strict=True)))
    assert sums == {r.bucket: r.n for r in resampling.bucket_totals(docs.where("doc_id IS NULL OR doc_id < 10"), run=run, buckets=50).collect()}


def test_no_rows_and_no_target(spark, nothing):
    target = spark.createDataFrame([("a b",)], "text string")
    assert resampling.resample(nothing, target).collect() == []
    docs = spark.createDataFrame(ODD[:6], "doc_id long, text string")
    assert told(resampling.resample(docs, target.where("false"))) == plain(ODD[:6], [])


def test_equal_rows_fill_many_ranges(spark):
    docs = spark.range(4000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("a b c d e f g h i j " * 3).alias("text"))
    got = resampling.resample(docs, docs.limit(3), percent=25)
    assert sorted(r["rank"] for r in got.where("rank IS NOT NULL").collect()) == list(range(1, 1001))
