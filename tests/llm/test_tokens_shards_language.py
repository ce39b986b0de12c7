import random

import public_tokenizers
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import common, language_id, sharding, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
RAW = open(PATH, "rb").read()
LIBRARY = Tokenizer.from_str(RAW.decode())
COUNTER = token_counts.Counter(RAW)


def library(texts):
    return [len(e) for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


ODD = ["", " ", "  ", "\n\n a", "it's 'quoted' we'll they're I've I'd 'llama 'rest 'very don't 'l 'r", "x'", "'r", "a   ", "  'tis", "\t\t'tis", "\t 's", "<|endoftext|> hi<|endoftext|><|endoftext|>", "日本語 émigré ß 😀😀 　x", "a\x00b\x1f", "''s", "1234 5.6,7 ½ Ⅷ", "a" * 5000, "ab" * 300 + " " * 40 + "z", "!'s !!'s 's's", "'re's", "\r\n\r\n x \r\n", "<|endoftext"]


def test_counts_of_odd_texts():
    assert COUNTER.token_counts(ODD).tolist() == library(ODD)


def test_counts_of_random_texts():
    rng = random.Random(5)
    texts = ["".join(rng.choice("abst'rvel \n\t.1é!") for _ in range(rng.randint(0, 80))) for _ in range(2000)]
    assert COUNTER.token_counts(texts).tolist() == library(texts)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200))
def test_counts_of_any_text(text):
    assert COUNTER.token_counts([text]).tolist() == library([text])


def test_chunks_do_not_matter():
    classes = COUNTER.classes[[ord(c) for c in "".join(ODD)]]
    want = token_counts.starts_of(classes, COUNTER.nxt, COUNTER.emit, 1 << 20).tolist()
    for chunk in (1, 2, 7, 64):
        assert token_counts.starts_of(classes, COUNTER.nxt, COUNTER.emit, chunk).tolist() == want


@pytest.mark.parametrize("span", [1, 2, 5, 64])
def test_maps_of_chunks_compose(span):
    rng = random.Random(span)
    texts = ODD + ["".join(rng.choice("abst'rvel \n\t.1é!") for _ in range(rng.randint(0, 300))) for _ in range(200)] + ["日本" * 200, "x" * 999 + " y"]
    assert COUNTER.token_counts(texts, span).tolist() == library(texts)


def test_composition_is_associative():
    rng = random.Random(7)
    m = COUNTER.merger
    for _ in range(100):
        made = lambda: (lambda exit_: token_counts.Span("".join(rng.choice("abcde") for _ in range(rng.randrange(6))), rng.randrange(5) if exit_ else 0, exit_))(rng.choice([None, m.keys[rng.randrange(len(m.keys))]]))
        a, b, c = made(), made(), made()
        assert m.composed(m.composed(a, b), c) == m.composed(a, m.composed(b, c))


def test_token_query(spark, sf_dir):
    texts = dict(zip(*[c.to_pylist() for c in pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).columns], strict=True))
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.op2_token_counts(spark, sf_dir).collect()}
    want = library(list(texts.values()))
    assert got == {k: (len(t.encode()), n, n > 512) for (k, t), n in zip(texts.items(), want, strict=True)}


def test_token_edge_cases(tiny, nothing):
    rows = token_counts.count_tokens(tiny, PATH).collect()
    assert len(rows) == 9 and {(r.n_bytes, r.n_tokens) for r in rows if r.doc_id in (2, 3)} == {(0, 0)}
    assert token_counts.count_tokens(nothing, PATH).count() == 0


def test_shards_match_sql(spark, sf_dir):
    import duckdb

    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = duck.execute(sharding.ORACLE)
    names = [c[0] for c in want.description]
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r[n] for n in names)) for r in sharding.op3_rendezvous_sharding(spark, sf_dir).collect())


def test_shards(spark, tiny, nothing, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_GROUP", 3)
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    rows = sharding.shard(docs, (1.0,) * 5).collect()
    assert all(r.grown_shard in (r.shard, 5) for r in rows) and {r.shard for r in rows} == set(range(5))
    assert 350 < sum(r.grown_shard == 5 for r in rows) < 650
    for s in range(5):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    heavy = sharding.shard(docs, (3.0, 1.0)).where("shard = 0").count()
    assert 2150 < heavy < 2350
    edge = sharding.shard(tiny, keep=["lang", "key", "text"]).collect()
    assert len(edge) == 9 and {r.size for r in edge if r.doc_id in (2, 3)} == {16} and {r.text_crc32 for r in edge if r.doc_id in (2, 3)} == {0}
    assert len({(r.shard, r.slot) for r in edge}) == 9
    assert sharding.shard(nothing).count() == 0


def test_clashing_columns_and_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_GROUP", 1)
    docs = spark.range(400).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.col("id").alias("size"), F.lit("x").alias("slot"), F.lit(1).alias("_shard_group"))
    rows = sharding.shard(docs, (1.0,) * 4, keep=["size", "slot", "_shard_group", "text"]).collect()
    assert len(rows) == 400 and len({r.shard for r in rows}) == 1 and sorted(r.slot for r in rows) == list(range(400))
    assert {(r.source_size, r.source_slot, r._shard_group, r.text) for r in rows} == {(i, "x", 1, f"text {i}") for i in range(400)}
    assert all(r.size == len(r.text) + 16 for r in rows)


def test_shards_are_even(spark):
    n = [r["count"] for r in sharding.shard(spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))).groupBy("shard").count().collect()]
    assert len(n) == 40 and sum((x - 1000) ** 2 / 1000 for x in n) < 80


def test_languages_against_plain_compression(spark, sf_dir):
    """Sizes, prediction and score of every document, with zstandard alone."""
    import re

    import zstandard

    docs = common.read(spark, sf_dir, "documents")
    made = language_id.learn(language_id.training_rows(docs))
    texts = {r.doc_id: r.text for r in docs.collect()}

    def packed(data, raw, level):
        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(level=level, dict_data=d, write_checksum=False, write_content_size=False).compress(data))

    checked = 0
    for r in language_id.identify(docs, made).collect():
        t = texts[r.doc_id]
        if len(t) > 4000 or not re.search(r"[^\W\d_]", t):
            continue
        raw = " ".join("".join(c if ord(c) > 127 or c.isalpha() else " " for c in t.lower()).encode().decode().split(" ")).encode()
        raw = b" ".join(raw.split())
        parts = max(1, -(-len(raw) // 1024))
        blocks = [raw[len(raw) * i // parts : len(raw) * (i + 1) // parts] for i in range(parts)]
        sizes = {}
        for lang, d in made.items():
            if parts == 1:
                sizes[lang] = max(1, packed(d[-256:] + blocks[0] + b" ", d, 12) - packed(d[-256:], d, 12))
            else:
                sizes[lang] = sum(packed(b, d, 5) for b in blocks)
        best = min(sorted(sizes), key=sizes.get)
        second = min(v for k, v in sizes.items() if k != best)
        assert (r.lang_pred, r.best_bytes, r.second_bytes) == (best, sizes[best], second)
        assert abs(r.score - min(1, (second / sizes[best] - 1) / 0.2)) < 1e-12 and r.rejected == (second / sizes[best] - 1 < 0.01)
        checked += 1
    assert checked > 100


def test_language_accuracy(spark, sf_dir):
    docs = common.read(spark, "/root/testdata/sf0.01", "documents")
    found = language_id.op4_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.97 * len(found)


def test_language_of_short_clean_documents(spark):
    docs = common.read(spark, "/root/testdata/sf0.1", "documents")
    made = language_id.learn(language_id.training_rows(docs))
    short = docs.where((F.size(F.split(F.trim("text"), r"\s+")) <= 10) & F.col("text").rlike("[A-Za-z]")).cache()
    rows = language_id.identify(short, made).join(short.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) > 100 and language_id.drop_rejected(short, made).count() == len(rows)
    told = [r for r in rows if r.second_bytes > r.best_bytes]
    assert len(told) >= 0.9 * len(rows) and sum(r.lang == r.lang_pred for r in told) >= 0.97 * len(told)


def test_language_learns_from_all_over_each_text(spark):
    rng = random.Random(3)
    body = lambda: "".join(rng.choice("abcdefgh ") for _ in range(6000))
    rows = [(i, "xx", "header " * 80 + body() + " farewell") for i in range(300)] + [(1000 + i, "yy", body()) for i in range(8)]
    made = language_id.learn(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    assert made["xx"].count(b"farewell") > 200 and made["xx"].count(b"header") < 256 * 30
    assert 40_000 < len(made["yy"]) <= language_id.DICTIONARY_BYTES


def test_language_drops_narrow_texts_of_many_blocks():
    made = language_id.compressors([b"the quick brown fox jumps over " * 9, b"der schnelle braune fuchs springt " * 9])
    assert language_id.kept("Zq.", made) and language_id.kept("The quick brown fox jumps", made)
    assert not language_id.kept("zqxw " * 1000, made) and not language_id.kept("12 !", made) and not language_id.kept(None, made)


def test_language_edge_cases(tiny, nothing):
    made = language_id.learn(tiny)
    assert set(made) == {"de", "en"}
    rows = language_id.identify(tiny, made).collect()
    assert len(rows) == 9 and all((r.lang_pred, r.score, r.rejected) == ("und", 0.0, True) for r in rows if r.doc_id in (2, 3, 5))
    assert all(0 <= r.score <= 1 for r in rows)
    assert language_id.learn(nothing) == {}
    assert {r.lang_pred for r in language_id.identify(tiny, {}).collect()} == {"und"}
    assert language_id.drop_rejected(nothing, made).count() == 0
    assert language_id.drop_rejected(tiny, made).columns == tiny.columns


@pytest.mark.parametrize("m", [3, 4])
def test_crc_mod(spark, m):
    import zlib

    rows = spark.range(50).select("id", common.crc_mod("id", m).alias("r")).collect()
    assert all(r.r == zlib.crc32(str(r.id).encode()) % m for r in rows)
