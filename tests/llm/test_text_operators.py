import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, decontamination, mixing, secrets, toxicity, warc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute_hits(texts, items, k=10):
    windows = {}
    for i, t in items:
        w = lowered(t)
        for j in range(max(1, len(w) - k + 1) if w else 0):
            windows.setdefault(tuple(w[j : j + k]), set()).add(str(i))
    out = []
    for t in texts:
        w = lowered(t)
        hit, found = [0] * len(w), set()
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                if (got := windows.get(tuple(w[j : j + n]))) is not None:
                    found |= got
                    hit[j : j + n] = [1] * n
        out.append((len(w), sum(hit), sorted(found)))
    return out


def scanned(texts, items):
    p = decontamination.Phrases(items)
    n, spans, found = decontamination.scan(texts, p)
    return [(int(a), int((s[:, 1] - s[:, 0]).sum()), sorted({p.items[j] for j in f.tolist()})) for a, s, f in zip(n, spans, found, strict=True)]


def test_hits_of_small_alphabets():
    rng = random.Random(1)
    for _ in range(25):
        texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(60))) for _ in range(12)] + ["", None]
        items = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(14)))) for i in range(8)] + [(8, None), (9, "zz")]
        assert scanned(texts, items) == brute_hits(texts, items)


def test_hits_of_the_query(spark, sf_dir):
    docs = pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{sf_dir}/benchmark.parquet").to_pylist()]
    want = {d["doc_id"]: (n, h, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), h > 0) for d, (n, h, i) in zip(docs, brute_hits([d["text"] for d in docs], items), strict=True)}
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontamination.op7_decontamination(spark, sf_dir).collect()}
    assert got == want and any(v[4] for v in want.values())


def test_many_blocks_agree_with_one(spark, sf_dir, monkeypatch):
    docs, bench = common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark")
    one = sorted(map(str, decontamination.digest(decontamination.contamination(docs, bench)).collect()))
    monkeypatch.setattr(decontamination, "BLOCK_WINDOWS", 300)
    monkeypatch.setattr(decontamination.blocks, "__defaults__", (300,))
    assert sorted(map(str, decontamination.digest(decontamination.contamination(docs, bench)).collect())) == one


def test_removal(spark):
    phrase = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    docs = spark.createDataFrame([(1, f"Before, {phrase.upper()}! after", 9), (2, "clean words stay here", 9), (3, None, 9), (4, f"{phrase} {phrase}", 9)], "doc_id int, text string, spans int")
    bench = spark.createDataFrame([(1, phrase)], "item_id int, text string")
    got = {r.doc_id: r.text for r in decontamination.remove_spans(docs, bench).collect()}
    assert got == {1: "Before, ! after", 2: "clean words stay here", 3: None, 4: " " if got[4] == " " else ""}
    clean = decontamination.contamination(decontamination.remove_spans(docs, bench), bench)
    assert decontamination.digest(clean).where("contaminated").count() == 0


def test_removal_in_many_blocks_agrees_with_one(spark, monkeypatch):
    w, a = [f"w{i}" for i in range(1, 21)], [f"a{i}" for i in range(1, 11)]
    b = [f"b{i}" for i in range(1, 11)]
    items = [" ".join(x) for x in (w[:12], a, w[7:], b)]
    texts = [f"x {' '.join(w)} y", f"x {' '.join(a[:5] + b + a[5:])} y", f"{' '.join(a + w + b)}, end", "nothing of this", None, f"x {' '.join(w[:9])} y"]
    docs, bench = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), spark.createDataFrame(list(enumerate(items)), "item_id int, text string").coalesce(1)
    cleaned = lambda: {r.doc_id: r.text for r in decontamination.remove_spans(docs, bench).collect()}
    one = cleaned()
    assert one == {0: "x  y", 1: "x  y", 2: ", end", 3: "nothing of this", 4: None, 5: texts[5]}
    monkeypatch.setattr(decontamination.blocks, "__defaults__", (12,))
    assert len(list(decontamination.blocks(bench, "item_id", "text"))) == 4 and cleaned() == one


def test_contamination_edge_cases(tiny, nothing, spark):
    bench = spark.createDataFrame([("b", "one"), ("a", "One!"), (None, "x")], "item_id string, text string")
    rows = decontamination.digest(decontamination.contamination(tiny, bench)).collect()
    assert len(rows) == 9 and [(r.n_hit, r.n_items) for r in rows if r.doc_id == 7] == [(1, 2), (1, 2)]
    assert decontamination.contamination(nothing, bench).count() == 0
    assert decontamination.digest(decontamination.contamination(tiny, bench.where("false"))).where("contaminated").count() == 0


def test_fm_index_ranks_and_places():
    rng = np.random.default_rng(2)
    s = np.append(rng.integers(0, 4, 500), 0)
    index = decontamination.FMIndex(s, 4)
    for n in (1, 2, 3):
        for p in [rng.integers(1, 4, n) for _ in range(10)]:
            row = np.zeros((1, 5), np.int64)
            row[0, 5 - n :] = p
            low, high = index.find(row)
            want = [i for i in range(len(s) - n + 1) if (s[i : i + n] == p).all()]
            assert sorted(index.locate(np.arange(low[0], high[0]))) == want


def test_warc_query_against_sql(spark, sf_dir):
    import duckdb

    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    want = duck.execute(warc.ORACLE)
    names = [c[0] for c in want.description]
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r[n] for n in names)) for r in warc.op8_warc(spark, sf_dir).collect())


def test_warc_round_trip(spark, tmp_path):
    import zstandard

    rows = [(3, "same", "http://a/"), (1, "same", "http://b/\r\nX: y"), (2, None, None), (4, "", None), (5, "é" * 9000, "u"), (None, "same", None), (1, "same", "http://b/")]
    pages = spark.createDataFrame(rows, "page_id long, html string, url string").coalesce(1)
    made = warc.archive(pages, str(tmp_path)).collect()
    assert sum(r.records for r in made) == 7
    raw = open(made[0].archive, "rb").read()
    assert int.from_bytes(raw[:4], "little") == warc.MAGIC
    size = int.from_bytes(raw[4:8], "little")
    first = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw[8 : 8 + size])).decompressobj().decompress(raw[8 + size :])
    assert first.startswith(b"WARC/1.1\r\n")
    back = warc.records_of(spark.createDataFrame(made), "bigint").collect()
    assert sorted((r.key or 0, r.payload_bytes, r.record_type, r.refers_to) for r in back) == [(0, 4, "revisit", 1), (1, 4, "response", None), (1, 4, "revisit", 1), (2, 0, "response", None), (3, 4, "revisit", 1), (4, 0, "revisit", 2), (5, 18000, "response", None)]
    assert warc.records_of(warc.archive(pages.where("false"), str(tmp_path / "none")), "bigint").count() == 0
    short = warc.archive(pages, str(tmp_path / "least"), least=5)
    assert warc.records_of(short, "bigint").where("record_type = 'revisit'").count() == 0
    for manifest in (made, short.collect()):
        fields = [r["fields"] for m in manifest for r in warc.Archive.read(m.archive)]
        ids = [f["WARC-Record-ID"] for f in fields]
        assert len(set(ids)) == len(ids) == 7
        responses = {f["WARC-Record-ID"]: f for f in fields if f["WARC-Type"] == "response"}
        for f in fields:
            if f["WARC-Type"] == "revisit":
                assert responses[f["WARC-Refers-To"]]["WARC-Payload-Digest"] == f["WARC-Payload-Digest"]
    with pytest.raises(ValueError, match="number or a string"):
        warc.records_of(short, "date")


def test_one_key_with_several_payloads(spark, tmp_path):
    rows = [(1, "a" * 50, "u"), (1, "b" * 50, "u"), (2, "a" * 50, "u"), (2, "b" * 50, "u")]
    pages = spark.createDataFrame(rows, "page_id long, html string, url string").repartition(3)
    made = warc.archive(pages, str(tmp_path))
    fields = [r["fields"] for m in made.collect() for r in warc.Archive.read(m.archive)]
    assert len({f["WARC-Record-ID"] for f in fields}) == 4
    where = {f["WARC-Record-ID"]: f["WARC-Payload-Digest"] for f in fields if f["WARC-Type"] == "response"}
    assert len(where) == 2 and all(where[f["WARC-Refers-To"]] == f["WARC-Payload-Digest"] for f in fields if f["WARC-Type"] == "revisit")
    assert made.collect() == made.collect() and len(list(tmp_path.iterdir())) == len(made.collect())


def test_secret_spans():
    key = "AKIA" + "ABCDEFGH12345678"
    text = f'é password = "hunter2hunter2" API_KEY:short {key} ' + "0123456789abcdef" * 2 + ' apikey=""x'
    base, every = secrets.all_spans(text)
    assert [(secrets.KINDS[k], text[a:b]) for a, k, b in base] == [("assign", 'password = "hunter2hunter2'), ("access", key), ("hex", "0123456789abcdef" * 2)]
    assert set(base) <= set(every)
    assert secrets.all_spans("AKIA" + "A" * 11)[0] == [] and len(secrets.all_spans("AKIA" + "A" * 12)[0]) == 1
    assert secrets.all_spans("id 123e4567-e89b-12d3-a456-426614174000 and " + "z" * 60)[1] == []
    assert any(k == 3 for _, k, _ in secrets.all_spans("x Zk9fQ2xJ7vPq1LmN8tRw3YsB x")[1])


def test_entropy_counts_are_right():
    rng = random.Random(8)
    for _ in range(40):
        s = "".join(rng.choice("abcdefgh0123") for _ in range(rng.randrange(20, 60)))
        want = set()
        for i in range(len(s) - 19):
            w = s[i : i + 20]
            h = -sum(w.count(c) / 20 * math.log2(w.count(c) / 20) for c in set(w))
            if h >= 3.1 - 1e-12:
                want |= set(range(i, i + 20))
        assert {p for a, b in secrets.hot_windows(s, 3.1) for p in range(a, b)} == want


def plain_base(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32])


def test_secret_query(spark, sf_dir):
    docs = dict(zip(*[c.to_pylist() for c in pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).columns], strict=True))
    for r in secrets.op9_secret_scan(spark, sf_dir).collect():
        base = plain_base(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(secrets.joined(base).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(x[1] == k for x in base) for k in range(3)]
        assert set(secrets.joined(base).split(",")) <= set(r.spans.split(","))


def test_secret_edge_cases(tiny, nothing):
    rows = secrets.find_secrets(tiny).collect()
    assert len(rows) == 9 and all(r.spans == "" for r in rows if r.doc_id in (2, 3))
    assert secrets.find_secrets(nothing).count() == 0


def auc(bad, good):
    return float(np.mean([(b > good).mean() + 0.5 * (b == good).mean() for b in bad]))


def test_toxicity_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{sf}/labels.parquet").to_pylist()}
    rows = toxicity.op10_toxicity(spark, sf).collect()
    assert len(rows) == 10_000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    bad, good = (np.array([r.score for r in held if labels[r.doc_id] == y]) for y in (1, 0))
    assert auc(bad, good) > 0.97 and np.mean(bad >= 0.3) > 0.85 and np.mean(good >= 0.3) < 0.02


def test_toxicity_scores_against_plain_python(spark, sf_dir):
    """Features by their definitions, trees walked node by node, the calibration line by line."""
    docs = common.read(spark, sf_dir, "documents")
    model = toxicity.learn(docs, common.read(spark, sf_dir, "labels"))
    words = {w for w in model.lexicon if not w.startswith("^")}
    stems = {w[1:] for w in model.lexicon if w.startswith("^")}
    hit = lambda w: w in words
    stem = lambda w: any(w.startswith(x) and len(w) > len(x) for x in stems)
    xs, ys = (list(map(float, k)) for k in model.knots)

    def line(v):
        if v <= xs[0] or v >= xs[-1]:
            return ys[0] if v <= xs[0] else ys[-1]
        i = max(i for i in range(len(xs)) if xs[i] <= v)
        return ys[i] + (ys[i + 1] - ys[i]) * (v - xs[i]) / (xs[i + 1] - xs[i])

    def plain(text):
        w = re.findall(r"[^\W\d_]+", text.lower())
        n, length = max(1, len(w)), len(text)
        at = [i for i, x in enumerate(w) if hit(x) or stem(x)]
        near = sum(any(x in toxicity.SECOND_PERSON for x in w[max(0, i - 5) : i + 6]) for i in at)
        capitals = sum("A" <= c <= "Z" for c in text)
        signs = sum(33 <= ord(c) < 127 and not c.isalnum() for c in text)
        shouted = sum(x.isupper() for x in text.split()) if capitals > 0.1 * length else 0
        masked = re.findall(r"[A-Za-z]+[0-9@$*!][A-Za-z0-9@$*!]*[A-Za-z]", text)
        back = [x.lower().translate(str.maketrans("013457@$!", "oieastasi")) for x in masked]
        return [math.log(1 + len(w)), sum(map(hit, w)), 100 * sum(map(hit, w)) / n, sum(map(stem, w)), 100 * sum(map(stem, w)) / n, len({w[i] for i in at}), 100 * near / n, capitals / length, shouted / n, 100 * text.count("!") / length, signs / length, 100 * len(masked) / n, sum(hit(x) or stem(x) for x in back)]

    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in toxicity.score(docs, model).collect():
        x = plain(texts[r.doc_id]) if texts[r.doc_id] else [0.0] * 13
        total = model.trees.start
        for feature, cut, value in model.trees.trees:
            node = 0
            while feature[node] >= 0:
                bin_ = sum(c <= x[feature[node]] for c in model.trees.cuts[feature[node]])
                node = 2 * node + 1 + (bin_ > cut[node])
            total += value[node]
        raw = 1 / (1 + math.exp(-total))
        want = min(1.0, max(0.0, 0.99 * line(raw) + 0.01 * raw))
        assert abs(r.score - want) < 1e-6 and r.predicted == int(r.score >= 0.3), r.doc_id


def test_toxicity_edge_cases(spark, tiny, nothing):
    labels = spark.createDataFrame([(1, 1), (1, 0), (6, 0), (7, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.learn(tiny, labels)
    assert toxicity.score(tiny, model).count() == 9
    assert toxicity.learn(tiny, labels.where("false")).constant == 0
    assert {r.score for r in toxicity.score(tiny, toxicity.learn(tiny, labels.where("toxic = 1"))).collect()} == {1.0}
    assert toxicity.score(nothing, model).count() == 0


def test_isotonic():
    x, y = toxicity.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]), np.ones(4))
    assert x.tolist() == [1, 2.5, 4] and y.tolist() == [0, 0.5, 1]


def test_rates_meet_targets(spark):
    rng = np.random.default_rng(5)
    p = rng.dirichlet((0.3, 0.3, 0.3), 400)
    n = rng.integers(1, 200, 400)
    table = spark.createDataFrame([(int(a), *map(float, b)) for a, b in zip(n, p, strict=True)], "tokens long, p0 double, p1 double, p2 double")
    rated, share = mixing.fit_rates(table, [6.0, 3.0, 1.0])
    rows = rated.collect()
    assert all(r.rate >= 0 for r in rows)
    got = [sum(r.tokens * r[f"p{d}"] * r.rate for r in rows) / n.sum() for d in range(3)]
    assert np.allclose(got, share) and np.allclose(got, [0.6, 0.3, 0.1], rtol=2e-3)


def test_rates_of_the_query_meet_the_targets(spark):
    rows = mixing.op6_mixing(spark, "/root/testdata/sf0.01").collect()
    total = sum(r.tokens for r in rows)
    for d, share in mixing.TARGETS.items():
        got = sum(r.tokens * r[f"p_{d}"] * r.rate for r in rows) / total
        assert abs(got - share) < 2e-4 * share and abs(got - rows[0][f"reached_{d}"]) < 1e-9
    assert all(r.rate >= 0 and r.rate <= r.copies + 1 and r.copies <= r.rate + 1 for r in rows)


def test_targets_that_cannot_be_met_end_and_tell(spark):
    table = spark.createDataFrame([(5, 1.0, 0.0), (7, 0.6, 0.4), (3, 0.9, 0.1)], "tokens long, p0 double, p1 double")
    rated, share = mixing.fit_rates(table, [0.1, 0.9])
    got = [sum(r.tokens * r[f"p{d}"] * r.rate for r in rated.collect()) / 15 for d in range(2)]
    assert np.allclose(got, share) and share[1] < 0.9 and all(r.rate >= 0 for r in rated.collect())


def test_elimination():
    rng = np.random.default_rng(3)
    for _ in range(20):
        a = rng.normal(size=(4, 4))
        a = a @ a.T
        b = rng.normal(size=4)
        assert np.allclose(mixing.solved(a.tolist(), b.tolist()), np.linalg.solve(a, b), rtol=1e-6)
    assert mixing.solved([[1.0, 1.0], [1.0, 1.0]], [2.0, 2.0]) in ([2.0, 0.0], [0.0, 2.0])


def test_posteriors_against_numpy(spark, sf_dir):
    """The same classifier, word by word in Python."""
    docs = common.read(spark, sf_dir, "documents")
    labelled = mixing.domains_of(common.read(spark, sf_dir, "labels"))
    model = mixing.learn(docs, labelled, ["good", "poor", "toxic"])
    weights = {r.bucket: (r.w0, r.w1, r.w2) for r in model.weights.collect()}
    hashed = {r.w: r.b for r in docs.select(F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("w")).distinct().select("w", F.pmod(F.xxhash64(F.lower("w")), F.lit(mixing.BUCKETS)).alias("b")).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}

    def mark(w):
        if w[-1:] == "!":
            return 0
        if w == "|":
            return 2
        if w and w[-1] in "%*&$#@~^|":
            return 1
        return 3 if len(w) > 2 and w.upper() == w and w.lower() != w else None

    for r in mixing.posteriors(docs, model).collect():
        w = re.split(r"[ \t\n\x0b\f\r]+", texts[r.key])
        n = sum(map(bool, w))
        z = np.zeros(3)
        for x in w:
            z += weights.get(hashed[x], (0, 0, 0))
            if mark(x) is not None:
                z += model.marks[mark(x)]
        z = z * 64 / max(64, n) + np.log(model.priors)
        e = np.exp(z - z.max())
        assert r.tokens == n and np.allclose([r.p0, r.p1, r.p2], e / e.sum(), atol=1e-9)


def test_mixing_edge_cases(spark, tiny, nothing):
    labelled = spark.createDataFrame([(1, "good"), (6, "poor"), (6, None), (None, "toxic")], "doc_id long, domain string")
    rows = mixing.mixed(tiny, labelled, mixing.TARGETS)
    assert rows.count() == 9 and rows.where("rate < 0 OR rate IS NULL").count() == 0
    assert mixing.mixed(tiny, labelled.where("false"), mixing.TARGETS).count() == 9
    assert mixing.mixed(nothing, labelled, mixing.TARGETS).count() == 0
    out = mixing.apply_rates(tiny, rows)
    assert out.columns == tiny.columns
    copies = {(r.doc_id, r.th): r.copies for r in rows.collect()}
    assert out.where("doc_id = 7").count() == 2 * next(v for k, v in copies.items() if k[0] == 7)


@pytest.mark.parametrize("rate", [0.25, 1.5])
def test_copies_expect_the_rate(spark, rate):
    docs = spark.range(4000).select(F.col("id").alias("key"), F.lit(1).cast("long").alias("th"))
    n = docs.select(F.sum(F.floor(F.lit(rate) + common.keyed_uniform(F.col("key"), F.col("th"), F.lit("copies"))))).first()[0]
    assert abs(n / 4000 - rate) < 0.05
