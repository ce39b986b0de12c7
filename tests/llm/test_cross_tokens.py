"""Aligned tokens against whole texts encoded by the libraries and groups cut where both sides end."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import cross_tokens

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def letters():
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = {}, 256
    for byte in range(256):
        if byte in own:
            out[chr(byte)] = byte
        else:
            out[chr(n)] = byte
            n += 1
    return out


@pytest.fixture(scope="module")
def plain():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    byte = letters()

    def groups(text):
        if not text:
            return []
        ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        ta = [bytes(byte[c] for c in a.id_to_token(i)) for i in ia]
        tb = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ib, b.id_to_piece(ib), strict=True)]
        if not b"".join(ta) == b"".join(tb) == (" " + text).encode():
            return []
        ea, eb = np.cumsum([len(x) for x in ta]).tolist(), np.cumsum([len(x) for x in tb]).tolist()
        out, i, j = [], 0, 0
        for end in sorted(set(ea) & set(eb)):
            p, q = ea.index(end) + 1, eb.index(end) + 1
            out.append((ia[i:p], ib[j:q]))
            i, j = p, q
        return out

    return groups


def brute(plain, texts):
    every = [plain(t) for t in texts]
    links = [Counter((x, y) for a, b in g for x in a for y in b) for g in every]
    count = Counter(p for c in links for p in c)
    most = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = []
    for g, c in zip(every, links, strict=True):
        told = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        sha = hashlib.sha256(told.encode()).hexdigest() if g else ""
        out.append((sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(c.values()), sum(n for p, n in c.items() if count[p] == most[p[0]]), sum(n * count[p] for p, n in c.items()), sha))
    return out


ODD = [
    "The quick brown fox, jumps; over the lazy dog's back. It isn't 12345 things!", "", None, " leading and trailing ", "two  spaces   and\ttabs\n\nlines   x", "▁ under ▁score a▁ b",
    "<|endoftext|> and <s> <unk> <0x41> </s>", "日本 語 Ünïcödé 😀 é ﬁ ½ ＡＢＣ", "​ zero 　 wide \x00 nul \x85 \x1c sep", "a" * 30_000, "ab " * 5000, "x", "....." * 400 + " ,,,, " + "क्" * 300,
    "The quick brown fox, jumps; over the lazy dog's back. It isn't 12345 things!", "one", "one",
]


def test_odd_texts_against_whole_encodings(spark, plain):
    docs = spark.createDataFrame([(i if i % 5 else None, t, i, "x") for i, t in enumerate(ODD)], "doc_id long, text string, key long, slice string").repartition(3)
    got = sorted(tuple(r[c] for c in COLUMNS) for r in cross_tokens.align(docs, A, B).collect())
    assert got == sorted(brute(plain, ODD))


def test_query_against_whole_encodings(spark, plain, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in cross_tokens.op11_cross_tokens(spark, sf_dir).collect()}
    assert got == dict(zip(docs, brute(plain, list(docs.values())), strict=True))


def test_any_slices_give_the_same(spark, plain, monkeypatch):
    monkeypatch.setattr(cross_tokens, "MOST_CHUNKS", 3)
    docs = spark.createDataFrame([(i, f"{t} {i % 3}") for i, t in enumerate(t for t in ODD if t)], "doc_id long, text string")
    want = sorted(brute(plain, [r.text for r in docs.collect()]))
    for n in (1, 4):
        assert sorted(tuple(r[c] for c in COLUMNS) for r in cross_tokens.align(docs.repartition(n), A, B).collect()) == want


def test_groups_and_pair_counts(spark, plain):
    texts = [t for t in ODD if t and len(t) < 200]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(list(g.a), list(g.b)) for g in r.groups] for r in cross_tokens.groups(docs, A, B).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}
    count = Counter(p for t in texts for p in {(x, y) for a, b in plain(t) for x in a for y in b})
    most = {a: max(n for (x, _), n in count.items() if x == a) for a, _ in count}
    assert {(r.a, r.b): (r.documents, r.best) for r in cross_tokens.pair_counts(docs, A, B).collect()} == {p: (n, n == most[p[0]]) for p, n in count.items()}


def test_no_rows(nothing):
    assert cross_tokens.align(nothing, A, B).collect() == []
    assert cross_tokens.groups(nothing, A, B).collect() == [] and cross_tokens.pair_counts(nothing, A, B).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40).flatmap(lambda n: st.tuples(st.just(n), st.lists(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1))))))
def test_components(case):
    n, edges = case
    want = list(range(n))
    for _ in range(n):
        for u, v in edges:
            want[u] = want[v] = min(want[u], want[v])
    u, v = (np.array([e[k] for e in edges], np.int64) for k in (0, 1))
    assert cross_tokens.connected(n, u, v).tolist() == want


def test_wide_groups_are_counted_by_ids(plain, monkeypatch):
    monkeypatch.setattr(cross_tokens, "WIDE", 0)
    pair = cross_tokens.Pair(open(A, "rb").read(), open(B, "rb").read())
    text = "unbelievable antidisestablishmentarianism aaaaaaaaaaaaaaaaaaaaaaa"
    at, _ = pair.pairs_of(pair.numbers(pair.chunks(text)))
    got = Counter()
    for code, n in zip(pair.code[at].tolist(), pair.times[at].tolist(), strict=True):
        got[code >> 32, code & 0xFFFFFFFF] += n
    assert got == Counter((x, y) for a, b in plain(text) for x in a for y in b)


@pytest.fixture(scope="module")
def pair():
    return cross_tokens.Pair(open(A, "rb").read(), open(B, "rb").read())


class Counted:
    """A tokenizer that counts the texts that it encodes."""

    def __init__(self, inner):
        self.inner, self.texts = inner, 0

    def __getattr__(self, name):
        def call(texts, **options):
            self.texts += len(texts)
            return getattr(self.inner, name)(texts, **options)

        return call


def told(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups).encode()


def test_new_chunks_share_texts(pair, plain, monkeypatch):
    """A call for each new chunk took half of the slices' CPU time."""
    words = [f"wo{i * 7919 % 3001}rd{i}" for i in range(3000)] + [" white edges ", "tail\n", "ﬁ", " x"]
    pair.forget()
    monkeypatch.setattr(pair, "a", Counted(pair.a))
    numbers = pair.numbers(words)
    assert pair.a.texts <= len(words) // 10
    assert [pair.groups[i] for i in numbers] == [told(plain(w)) for w in words]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(min_size=1, max_size=12) | st.sampled_from(["ab cd", "ﬁ", "Ａ x", "\n", " y", "z ", "▁a b", "<|endoftext|> q", "\x1c a", "é ́b"]), max_size=150))
def test_joined_chunks_are_as_alone(pair, plain, texts):
    pair.forget()
    chunks = [c for t in texts for c in pair.chunks(t)]
    numbers = pair.numbers(chunks).tolist()
    want = [plain(c) for c in chunks]
    assert [pair.groups[i] for i in numbers] == list(map(told, want))
    assert [bool(pair.good[i]) for i in numbers] == [bool(g) for g in want]
    links = [Counter((x, y) for a, b in g for x in a for y in b) for g in want]
    assert pair.counts[numbers].tolist() == [[sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(n.values())] for g, n in zip(want, links, strict=True)]
    for i, n in zip(numbers, links, strict=True):
        at = slice(pair.begin[i], pair.begin[i + 1])
        assert {(c >> 32, c & 0xFFFFFFFF): k for c, k in zip(pair.code[at].tolist(), pair.times[at].tolist(), strict=True)} == n


def test_where_tokens_do_not_spell_the_text(pair, plain, monkeypatch):
    """A vocabulary that writes some bytes otherwise: only those chunks are bad, whatever they are encoded beside."""
    chunks = ["plain", "words", "Zebra", "more words", "a Zebra b", "end"]
    spelt = pair.bytes_a.copy()
    for i in {i for c in ("Zebra", "a Zebra b") for i in pair.a.encode(" " + c, add_special_tokens=False).ids} - {i for c in ("plain", "words", "more words", "end", "a b") for i in pair.a.encode(" " + c, add_special_tokens=False).ids}:
        spelt[i] = b"?" * len(spelt[i])
    pair.forget()
    monkeypatch.setattr(pair, "bytes_a", spelt)
    numbers = pair.numbers(chunks)
    assert pair.good[numbers].tolist() == [True, True, False, True, False, True]
    assert [pair.groups[i] for i in numbers] == [b"" if "Z" in c else told(plain(c)) for c in chunks]
    pair.forget()


@given(st.lists(st.sampled_from(["a", " ", "  ", "\n", "\x1c", " ", "́", "é"]) | st.text(max_size=3)).map("".join))
def test_cuts_stand_between_characters_that_are_not_white(text):
    places = [i for i in range(1, len(text) - 1) if text[i] == " " and not text[i - 1].isspace() and not text[i + 1].isspace()]
    assert [m.start() for m in cross_tokens._CUT.finditer(text)] == places
