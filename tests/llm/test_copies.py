import collections
import hashlib
import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, edit_fingerprint, jaccard_join, shingles


def words_like(rng, n):
    return [f"w{rng.randrange(3000)}" for _ in range(n)]


def brute(texts, num=4, den=5):
    """Links and classes at similarity num / den of word 5-shingles."""
    sets = {}
    for k, t in texts.items():
        w = (t or "").lower().encode().translate(shingles._WORDS).split()
        sets[k] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])
    inverted = collections.defaultdict(list)
    for k, v in sets.items():
        for g in v:
            inverted[g].append(k)
    links, root = collections.Counter(), {k: k for k in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, v in sets.items():
        common_ = collections.Counter(o for g in v for o in inverted[g])
        for o, n in common_.items():
            if o > k and den * n >= num * (len(v) + len(sets[o]) - n):
                links[k] += 1
                links[o] += 1
                a, b = find(k), find(o)
                root[max(a, b)] = min(a, b)
    return links, {k: find(k) for k in texts}


def check(found, texts):
    links, root = brute(texts)
    got = {r.doc_id: r for r in found.collect()}
    assert got.keys() == texts.keys()
    assert {k: got[k].n_links for k in texts} == {k: links[k] for k in texts}
    assert {k: got[k].class_id for k in texts} == root


def test_join_against_brute_force(spark):
    texts = dict(zip(*[c.to_pylist() for c in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"]).columns], strict=True))
    check(jaccard_join.op5_jaccard_join(spark, "/root/testdata/sf0.01"), texts)


@pytest.mark.parametrize("block", [100_000, 900])
def test_join_of_a_large_group(spark, monkeypatch, block):
    """One group of near copies over many blocks, copies, chains and short texts."""
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rng = random.Random(block)
    base = words_like(rng, 60)
    texts = {}
    for i in range(120):
        w = list(base)
        for _ in range(rng.choice((0, 1, 1, 2))):
            w[rng.randrange(60)] = f"n{rng.randrange(10**6)}"
        texts[i] = " ".join(w)
    chain = words_like(rng, 100)
    for i in range(120, 140):
        texts[i] = " ".join(chain[(i - 120) * 3 : 80 + (i - 120) * 3])
    texts |= {140: "a b c", 141: "A, b: c", 142: "a b c d", 143: "", 144: None, 145: "..."}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check(jaccard_join.near_classes(docs), texts)
    kept = {r.doc_id for r in jaccard_join.one_of_each(docs).collect()}
    assert kept == {k for k, v in brute(texts)[1].items() if k == v}


def test_join_edge_cases(spark, tiny, nothing):
    rows = jaccard_join.near_classes(tiny).collect()
    assert len(rows) == 9
    by = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert by[4][0].class_id == 1 and by[1][0].n_links == 1 and by[2][0].n_links == by[3][0].n_links == 0
    assert [r.n_links for r in by[7]] == [1, 1] and by[None][0].class_id is None
    kept = jaccard_join.one_of_each(tiny)
    assert kept.columns == tiny.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 5, 6, 7]
    assert jaccard_join.near_classes(nothing).count() == 0 and jaccard_join.one_of_each(nothing).count() == 0


def test_prefixes_shorten_to_the_target():
    lengths = [jaccard_join.prefix_length(0.8, t) for t in (0.5, 0.99, 0.999, 0.999999)]
    assert lengths == sorted(lengths, reverse=True)
    for t, k in zip((0.99, 0.999), lengths[1:], strict=False):
        assert 1 - (1 - 0.8**k) ** jaccard_join.TREES >= t > 1 - (1 - 0.8 ** (k + 1)) ** jaccard_join.TREES or k == jaccard_join.LONGEST


def test_depths_follow_from_what_a_set_can_have():
    for n in range(1, 40):
        want = min(c / (n + e) for c in range(1, n + 1) for e in range(n + 1) if 5 * c >= 4 * (n + e))
        assert abs(jaccard_join.least_similarity(n, 0.8) - want) < 1e-12
    d = jaccard_join.depths(0.8, 0.999)
    assert d[3] == jaccard_join.LONGEST > d[4] == d[-1] == jaccard_join.prefix_length()


def test_prefixes_shorten_by_what_they_meet(spark):
    """Texts without company keep the longest prefix; texts near others shorten it, at any number of ranges."""
    rng = random.Random(8)
    texts = {i: " ".join(words_like(rng, 90)) for i in range(200)}
    for i in range(200, 260):
        w = texts[i - 200].split()
        w[45] = "other"
        texts[i] = " ".join(w)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    classes = jaccard_join.described(docs, "doc_id", "text", 0.8, 0.999)
    depth = {}
    met = jaccard_join.company(classes, jaccard_join.EVIDENCE)
    for r in jaccard_join.with_depths(met, 0.8, 0.999).join(classes, "h1").select("key", "depth").collect():
        depth[r.key] = r.depth
    near = {i for i in texts if i < 60 or i >= 200}
    assert all(depth[i] == 7 for i in near)
    assert all(depth.get(i, 8) == 8 for i in texts if i not in near)


def test_spent_chance_of_missing():
    """All tests together, worked out tree by tree, leave no more than the target's chance of a miss."""
    rng = np.random.default_rng(2)
    for target in (0.9, 0.99, 0.999):
        for least, by_depth in jaccard_join.enough_company(0.8, target).items():
            s = 0.8
            levels = rng.geometric(1 - s, (200_000, jaccard_join.TREES)) - 1  # levels that two texts of similarity s share
            deepest, kept = levels.max(1), np.zeros(200_000, bool)
            for k, most in by_depth.items():
                few = np.zeros(200_000, bool)
                for j, c in most.items():
                    few |= (levels >= j).sum(1) <= c
                kept |= few & (deepest < k)
            missed = kept | (deepest < least)
            assert missed.mean() <= (1 - target) * 1.1 + 1e-4


def test_runs_of_sorted_labels_are_trie_nodes():
    rng = np.random.default_rng(5)
    depth = rng.integers(2, 5, 300)
    sig = rng.integers(0, 2, (300, jaccard_join.BINS), dtype=np.uint64) + np.uint64(7)
    label = jaccard_join.labels_of(sig, depth)[:, :3].reshape(-1, 2)
    label = label[np.lexsort((label[:, 1], label[:, 0]))]
    levels = [tuple([r[0] >> 56, *(r[0] >> s & 16383 for s in (42, 28, 14, 0)), *(r[1] >> 4 >> s & 16383 for s in (42, 28, 14, 0))]) for r in label.tolist()]
    nodes = collections.defaultdict(list)
    for i, x in enumerate(levels):
        nodes[x[: 1 + (label[i, 1] & 15)]]
    for i, x in enumerate(levels):
        for d in range(2, 5):
            if x[: 1 + d] in nodes:
                nodes[x[: 1 + d]].append(i)
    want = np.zeros(len(label) - 1, bool)
    for at in nodes.values():
        assert at == list(range(at[0], at[-1] + 1))
        want[at[0] : at[-1]] = True
    assert (jaccard_join.matched(label, (False, False)) == want).all()
    for i in range(len(label) - 1):
        same = next((k for k in range(9) if levels[i][k] != levels[i + 1][k]), 9)
        assert jaccard_join.common_levels(label[i : i + 1], label[i + 1 : i + 2])[0] == max(0, same - 1)


@pytest.mark.parametrize(("num", "den"), [(4, 5), (3, 5), (2, 5)])
def test_recall_at_thresholds(spark, num, den):
    """Pairs of many similarities: the share of links found, at 0.8 and below, against brute force."""
    rng = random.Random(num)
    texts = {}
    for i in range(0, 600, 2):
        w = words_like(rng, 80)
        texts[i] = " ".join(w)
        for _ in range(rng.randrange(9)):
            w[rng.randrange(80)] = "other"
        texts[i + 1] = " ".join(w)
    links, _ = brute(texts, num, den)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(7)
    got = {r.doc_id: r.n_links for r in jaccard_join.near_classes(docs, threshold=num / den).collect()}
    assert all(got[k] <= links[k] for k in texts) and sum(got.values()) >= 0.995 * sum(links.values()) > 100


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (102, 101)], "a long, b long")
    assert {r.node: r.label for r in jaccard_join.components(edges).collect()} == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100, 102: 100}


def test_fingerprints(spark, sf_dir):
    got = {r.doc_id: r for r in edit_fingerprint.op1_edit_fingerprint(spark, sf_dir).collect()}
    texts = dict(sorted(zip(*[c.to_pylist() for c in pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).columns], strict=True)))
    ids = list(texts)
    assert list(sorted(got)) == ids
    for k, nxt in zip(ids, ids[1:] + ids[:1], strict=True):
        t = texts[k]
        n = len(t) // 4
        want = t[: len(t) - n] + texts[nxt][:n]
        assert got[k].edited_sha256 == hashlib.sha256(want.encode()).hexdigest() and got[k].n_chars == len(t)
        w = edit_fingerprint.walks()
        alone = [w.digest(c, w.walk([c], np.zeros((1, edit_fingerprint.WALKS), np.int64))[0]) for c in (w.classes(t), w.classes(want))]
        assert [edit_fingerprint.as_text(x) for x in alone] == [got[k].fingerprint, got[k].edited_fingerprint]
        assert got[k].near_edited == edit_fingerprint.likeness(*alone)
    long = [r for r in got.values() if r.n_chars > 200]
    assert min(r.near_edited for r in long) > 0.55 and np.mean([r.near_next for r in long]) < 0.1


def test_fingerprints_find_edits():
    rng = random.Random(3)
    w = edit_fingerprint.walks()
    text = " ".join(words_like(rng, 400))
    place = rng.randrange(len(text))
    some = text[:place] + "XYZ" + text[place + 2 :]
    a, b, c = (w.digest(x, w.walk([x], np.zeros((1, edit_fingerprint.WALKS), np.int64))[0]) for x in map(w.classes, (text, some, " ".join(words_like(rng, 400)))))
    assert edit_fingerprint.likeness(a, b) > 0.5 > 0.2 > edit_fingerprint.likeness(a, c)


def naive_fingerprint(text):
    """Character by character, step by step, from the shared bits alone."""
    e = edit_fingerprint
    bits = e._bits("move", e.WALKS * e.CLASSES * e.PERIOD).reshape(e.WALKS, e.CLASSES, e.PERIOD) & 1
    codes = e.Walks.classes(text).tolist()
    symbols, nothing, places = e.walks().nibble, e.walks().nothing, e.walks().places
    out = ""
    for w in range(e.WALKS):
        emitted, at, step = [], 0, 0
        while at < len(codes):
            emitted.append(codes[at])
            at += int(bits[w, codes[at], step % e.PERIOD]) or step % e.PERIOD == e.PERIOD - 1
            step += 1
        for k in range(e.SAMPLES):
            if not emitted:
                out += f"{nothing[w, k]:x}"
                continue
            place = [p for p in places[w, k].tolist() if p < len(emitted)][-1]
            out += f"{symbols[w, k, emitted[place]]:x}"
    return out


def naive_likeness(a, b):
    n = len(a) // edit_fingerprint.WALKS
    best = max(sum(x == y for x, y in zip(a[i : i + n], b[i : i + n], strict=True)) / n for i in range(0, len(a), n))
    return max(0.0, (best - 0.125) / 0.875)


def test_fingerprints_against_a_naive_walk(spark):
    docs = common.read(spark, "/root/testdata/sf0.001", "documents").where("char_length(text) < 3000").limit(60)
    docs = spark.createDataFrame([(r.doc_id, r.text) for r in docs.collect()] + [(-1, None), (-2, ""), (10**9, "né 日本 😀" * 9)], "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in edit_fingerprint.fingerprint(docs).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    ids = sorted(texts)
    for k, nxt in zip(ids, ids[1:] + ids[:1], strict=True):
        own, other, beside = naive_fingerprint(texts[k]), naive_fingerprint(edit_fingerprint.edited(texts[k], texts[nxt])), naive_fingerprint(texts[nxt])
        r = got[k]
        assert (r.n_chars, r.fingerprint, r.edited_fingerprint) == (len(texts[k]), own, other)
        assert abs(r.near_edited - naive_likeness(own, other)) < 1e-12 and abs(r.near_next - naive_likeness(own, beside)) < 1e-12


def test_bands_are_bit_samples(spark):
    prints = spark.createDataFrame([("0123456789abcdef" * 16,)], "p string")
    got = prints.select(edit_fingerprint.bands("p").alias("b")).first()["b"]
    assert len(got) == 64 and got[:3] == ["0:0123", "4:4567", "8:89ab"] and got[32] == "128:0123"


def test_edit_links_recall(spark):
    """Families of texts a few edits from one another, some only by way of others, against all pairs."""
    rng = random.Random(12)
    texts = {}
    for family in range(12):
        base = " ".join(words_like(rng, 90))
        for member in range(rng.choice((1, 2, 4, 9))):
            t = list(base)
            for _ in range(rng.randrange(0, 12)):
                at = rng.randrange(len(t))
                t[at : at + rng.choice((0, 1, 2))] = rng.choice(("", "q", "zz"))
            texts[len(texts)] = "".join(t)
            if member % 3 == 2:
                base = texts[len(texts) - 1]
    stands = {t: min(k for k, u in texts.items() if u == t) for t in texts.values()}
    ids = sorted(stands.values())
    want = {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if texts[a] != texts[b] and edit_fingerprint.edit_distance_within(texts[a], texts[b], int(0.1 * max(len(texts[a]), len(texts[b])))) is not None}
    found = edit_fingerprint.near_links(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert all((r.a, r.b) in want and edit_fingerprint.edit_distance_within(texts[r.a], texts[r.b], r.distance) == r.distance for r in found)
    root = {k: k for k in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in found:
        root[find(r.b)] = find(r.a)
    assert len(want) > 60 and sum(find(a) == find(b) for a, b in want) >= 0.95 * len(want)


def test_fingerprint_edge_cases(spark, tiny, nothing):
    rows = edit_fingerprint.fingerprint(tiny).collect()
    assert len(rows) == 9 and len({r.fingerprint for r in rows if r.doc_id in (2, 3)}) == 1
    assert len({r.fingerprint for r in rows if r.doc_id in (1, 4)}) == 1
    assert edit_fingerprint.fingerprint(nothing).count() == 0
    single = edit_fingerprint.fingerprint(tiny.where("doc_id = 1")).collect()
    assert len(single) == 1 and single[0].near_next == 1


def test_edit_distance():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    rng = random.Random(9)
    for _ in range(300):
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(30)))
        b = "".join(rng.choice("ab") for _ in range(rng.randrange(30)))
        for most in (2, 8, 40):
            d = plain(a, b)
            assert edit_fingerprint.edit_distance_within(a, b, most) == (d if d <= most else None)


def test_edit_links(spark):
    rng = random.Random(4)
    text = " ".join(words_like(rng, 150))
    rows = [(1, text), (2, text[:300] + text[303:]), (3, " ".join(words_like(rng, 150))), (4, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [(r.a, r.b, r.distance) for r in edit_fingerprint.near_links(docs).collect()] == [(1, 2, 3)]


def test_shared_folder_is_the_session_s(spark):
    assert common.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert common.cut(spark.range(3).select(F.col("id"))).count() == 3
