"""Alignment of two tokenizers' tokens: A a byte-level BPE of the tokenizers library (.json), B a sentencepiece model.

A text's tokens of A and of B are the two sides of a graph; a token of A and one of B are joined where their byte ranges
overlap. The connected components, found by union-find, are the minimal groups: between two of them both tokenizers end a token.
Every A-B pair inside a component is a link. Links of equal ids are counted by the documents that hold them, corpus-wide.

A text is cut where one space stands between two characters that are not white. No piece of B has a space but at its front, and
A's splitter starts anew at such a space, so both tokenizers end a token there and a chunk's tokens do not depend on
its neighbours (a model for which that does not hold gets whole texts as chunks). Equal chunks are aligned once and remembered by a worker.

What moves: for each slice of texts, its distinct id pairs with the number of its documents (a row each), to be summed by pair, and back
to their slice; beside them what its documents hold, packed. The highest count of an A id is a row for each id of A's vocabulary.

Defined results: NULL, empty texts, and texts whose tokens' bytes joined differ from a space and the text (on either side) have no
tokens: zeros and the empty string. A very long text is a slice of its own. Repeated rows are documents of their own. Ties for an A
id's highest count all count as highest. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import gathered, read, scratch, stored
from .token_counts import byte_letters

#: Bytes of texts that a slice has; its distinct pairs are shuffled, so a longer slice moves less.
SLICE = 2_000_000
#: Chunks that a worker remembers, and their characters; beyond that it begins anew.
MOST_CHUNKS, MOST_CHARS = 250_000, 5_000_000
#: Chunks that A encodes as one text: a call for each chunk takes twice the time. What the next few are is all that this changes.
JOINED = 50
#: Groups whose A times B tokens are more than this are counted by distinct ids, not spread out.
WIDE = 4096

_CUT = re.compile(r" (?<=\S )(?=\S)")  # begins with the space, which the engine finds fast


def connected(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Union-find over n nodes and the edges (u, v), all edges at a time: the least node of each node's component."""
    root = np.arange(n)
    while len(u):
        ru, rv = root[u], root[v]
        apart = ru != rv
        if not apart.any():
            break
        u, v, ru, rv = u[apart], v[apart], ru[apart], rv[apart]
        np.minimum.at(root, np.maximum(ru, rv), np.minimum(ru, rv))
        while True:
            further = root[root]
            if (further == root).all():
                break
            root = further
    return root


class Pair:
    """Both tokenizers with the bytes of their tokens, and the chunks that were aligned so far."""

    def __init__(self, a: bytes, b: bytes) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        spec = json.loads(a)
        self.a = Tokenizer.from_str(a.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        letters = byte_letters()
        self.bytes_a: list[bytes] = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.size_b = np.array([len(x) for x in self.bytes_b], np.int64)
        splitter = spec.get("pre_tokenizer") or {}
        # What a token is in the digest's text: within its side of a group, the last of A's, the last of B's.
        self.told = [b"%d%c" % (i, c) for i in range(max(len(self.bytes_a), len(pieces))) for c in b",|;"]
        self.size_told = np.array([len(x) for x in self.told], np.int64)
        self.cuts = not spec.get("normalizer") and splitter.get("type") == "ByteLevel" and splitter.get("use_regex", True) and not any("▁" in p.lstrip("▁") for p in pieces)
        self.forget()

    def forget(self) -> None:
        self.known: defaultdict[str, int] = defaultdict(count().__next__)
        self.chars = 0
        self.groups: list[bytes] = []  # the digest's text of each chunk
        self.good = np.zeros(0, bool)
        self.counts = np.zeros((0, 4), np.int64)  # A tokens, B tokens, groups, links
        self.begin = np.zeros(1, np.int64)  # where the pairs of each chunk begin
        self.code, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def chunks(self, text: str | None) -> list[str]:
        if not text:
            return []
        return _CUT.split(text) if self.cuts else [text]

    def numbers(self, chunks: list[str]) -> np.ndarray:
        """The numbers of chunks; new ones are aligned."""
        before = len(self.known)
        out = np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))
        if len(self.known) > before:
            new = list(islice(self.known, before, None))
            self.chars += sum(map(len, new))
            self.learn(new)
        return out

    def learn(self, new: list[str]) -> None:
        parts = [self.align(new[at : at + 20_000]) for at in range(0, len(new), 20_000)]
        good, counts, held, code, times, groups = zip(*parts, strict=True)
        self.good = np.concatenate([self.good, *good])
        self.counts = np.concatenate([self.counts, *counts])
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(np.concatenate(held))])
        self.code, self.times = np.concatenate([self.code, *code]), np.concatenate([self.times, *times])
        self.groups += chain.from_iterable(groups)

    def encoded_a(self, chunks: list[str], raw: bytes, want: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A's ids of the chunks, how many each has, and whether they spell it. Chunks without white edges are encoded some at a time: a space stands
        between them, as in a text. raw, want: the chunks with their spaces in UTF-8, and how many bytes each has."""
        if self.cuts:
            texts = []
            for at in range(0, len(chunks), JOINED):
                part = chunks[at : at + JOINED]
                white = any(c[0].isspace() or c[-1].isspace() for c in part)
                texts += [" " + c for c in part] if white else [" " + " ".join(part)]
            ids = list(chain.from_iterable(x.ids for x in self.a.encode_batch_fast(texts, add_special_tokens=False)))
            if b"".join(map(self.bytes_a.__getitem__, ids)) == raw:
                out = np.array(ids, np.int64)
                stops, ends = np.cumsum(self.size_a[out]), np.cumsum(want)
                last = np.searchsorted(stops, ends)
                if (stops[last] == ends).all():
                    return out, np.diff(last, prepend=-1), np.ones(len(chunks), bool)
        out, each = flat([x.ids for x in self.a.encode_batch_fast([" " + c for c in chunks], add_special_tokens=False)])
        return out, each, spelled(out, each, self.bytes_a, self.size_a, raw, want)

    def align(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """Of each chunk: whether it is good, its counts, its number of pairs; their ids and times; the digest's text."""
        n = len(chunks)
        whole = [(" " + c).encode() for c in chunks]
        want = np.fromiter(map(len, whole), np.int64, n)
        raw = b"".join(whole)
        a, na, good = self.encoded_a(chunks, raw, want)
        b, nb = flat(self.b.encode(chunks, num_threads=1))
        good &= spelled(b, nb, self.bytes_b, self.size_b, raw, want)
        use = np.flatnonzero(good)
        if len(use) < n:
            a, b = a[np.repeat(good, na)], b[np.repeat(good, nb)]
            na, nb = na[use], nb[use]
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        # Each piece between two neighbouring ends lies in one token of either side: an edge of the overlap graph.
        is_end = np.zeros(int(want[use].sum()) + 1, bool)
        is_end[end_a] = is_end[end_b] = True
        ends = np.flatnonzero(is_end)
        of_a, of_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        root = connected(len(a) + len(b), of_a, of_b + len(a))
        # Components are numbered in the order of their least token of A, which is that of the text.
        group = np.cumsum(root == np.arange(len(root)))[root] - 1
        ga, gb = group[: len(a)], group[len(a) :]
        groups = int(ga[-1]) + 1 if len(ga) else 0
        owner = np.repeat(np.arange(len(use)), na)
        of_group = np.zeros(groups, np.int64)
        of_group[ga] = owner
        wide_a, wide_b = np.bincount(ga, minlength=groups), np.bincount(gb, minlength=groups)
        counts = np.zeros((n, 4), np.int64)
        counts[use] = np.stack([na, nb, np.bincount(of_group, minlength=len(use)), np.bincount(of_group, wide_a * wide_b, len(use)).astype(np.int64)], 1)
        # Links, as id pairs with the number of their occurrences in the chunk.
        many = len(self.bytes_b)
        first_b = np.cumsum(wide_b) - wide_b
        spread = (wide_a * wide_b <= WIDE)[ga]
        mine, each = a[spread], wide_b[ga[spread]]
        at = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each) + np.repeat(first_b[ga[spread]], each)
        codes, owners, times = [np.repeat(mine * many, each) + b[at]], [np.repeat(owner[spread], each)], [np.ones(len(at), np.int64)]
        for g in np.flatnonzero(wide_a * wide_b > WIDE):
            (x, nx), (y, ny) = (np.unique(ids[of == g], return_counts=True) for ids, of in ((a, ga), (b, gb)))
            codes.append((x[:, None] * many + y[None, :]).ravel())
            times.append((nx[:, None] * ny[None, :]).ravel())
            owners.append(np.full(len(codes[-1]), of_group[g]))
        owner_of, code, times_of = summed(np.concatenate(owners), np.concatenate(codes), np.concatenate(times), len(self.bytes_a) * many)
        held = np.zeros(n, np.int64)
        held[use] = np.bincount(owner_of, minlength=len(use))
        # The text of the digest: a token's id, then what follows it. Before it stand the tokens of its own side and those of the other side's groups so far.
        ids = np.empty(len(a) + len(b), np.int64)
        ids[np.arange(len(a)) + first_b[ga]] = a * 3 + (np.diff(ga, append=-1) != 0)
        ids[np.arange(len(b)) + np.cumsum(wide_a)[gb]] = b * 3 + 2 * (np.diff(gb, append=-1) != 0)
        told = b"".join(map(self.told.__getitem__, ids.tolist()))
        stops = np.concatenate([[0], np.cumsum(self.size_told[ids])])[np.cumsum(na + nb)].tolist()
        texts = [b""] * n
        for i, start, stop in zip(use.tolist(), [0, *stops], stops, strict=False):
            texts[i] = told[start : stop - 1]
        return good, counts, held, code // many << 32 | code % many, times_of, texts

    def pairs_of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in `code` the pairs of the numbered chunks are, one chunk after the other, and how many each has."""
        each = self.begin[numbers + 1] - self.begin[numbers]
        return np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each) + np.repeat(self.begin[numbers], each), each


def flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids, and how many each list has."""
    each = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), np.int64, int(each.sum())), each


def spelled(ids: np.ndarray, each: np.ndarray, spelling: list[bytes], size: np.ndarray, raw: bytes, want: np.ndarray) -> np.ndarray:
    """Of which chunks the tokens' bytes joined are the chunk's own. raw, want: the chunks' bytes, and how many each has."""
    n = len(each)
    good = np.bincount(np.repeat(np.arange(n), each), size[ids], n).astype(np.int64) == want
    letters = np.frombuffer(raw, np.uint8)
    if not good.all():
        ids, letters = ids[np.repeat(good, each)], letters[np.repeat(good, want)]
    same_size = np.flatnonzero(good)
    wrong = np.flatnonzero(np.frombuffer(b"".join(map(spelling.__getitem__, ids.tolist())), np.uint8) != letters)
    good[same_size[np.searchsorted(np.cumsum(want[same_size]), wrong, "right")]] = False
    return good


def summed(owner: np.ndarray, code: np.ndarray, times: np.ndarray, codes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of equal owner and code, in their order, with the sum of their times. Codes are less than `codes`; owners times codes fit 63 bits."""
    both = owner * codes + code
    order = np.argsort(both)
    both, times = both[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])[: len(both)])
    both = both[first]
    return both // max(1, codes), both % max(1, codes), np.add.reduceat(times, first) if len(first) else times


_pairs: dict[bytes, Pair] = {}


def pair_of(a: bytes, b: bytes) -> Pair:
    """The worker's own pair: it stays from task to task."""
    name = hashlib.sha256(a).digest() + hashlib.sha256(b).digest()
    if name not in _pairs:
        _pairs.clear()
        _pairs[name] = Pair(a, b)
    pair = _pairs[name]
    if len(pair.groups) > MOST_CHUNKS or pair.chars > MOST_CHARS:
        pair.forget()
    return pair


def contents(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def as_bytes(rows: pa.RecordBatch) -> bytes:
    """As an Arrow stream. The rows of pairs go with empty columns for a head's; Spark takes several times as long over those rows if one is nested."""
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, rows.schema) as stream:
        stream.write_batch(rows)
    return out.getvalue().to_pybytes()


def sliced(docs: DataFrame, a_path: str, b_path: str, key: str, text: str) -> DataFrame:
    """A row for each slice: its number, its documents, its distinct pairs with their documents, and which pair each document holds how often."""
    import zstandard  # noqa: F401  (every executor needs it)

    sent = docs.sparkSession.sparkContext.broadcast((contents(a_path), contents(b_path)))  # the files' sizes bound it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        packer = zstandard.ZstdCompressor(level=3)
        task = TaskContext.get().partitionId() << 32
        for number, part in enumerate(gathered(batches, text, SLICE)):
            pair = pair_of(*sent.value)
            chunks = [pair.chunks(t) for t in part.column(text).to_pylist()]
            n = len(chunks)
            size = np.array([len(x) for x in chunks], np.int64)
            ids = pair.numbers(list(chain.from_iterable(chunks)))
            cuts = np.concatenate([[0], np.cumsum(size)])
            owner = np.repeat(np.arange(n), size)
            bad = np.bincount(owner[~pair.good[ids]], minlength=n) > 0
            sums = np.stack([np.bincount(owner, pair.counts[ids, k], n) for k in range(4)], 1).astype(np.int64)
            sums[bad] = 0
            told = pair.groups
            shas = ["" if bad[i] or not size[i] else hashlib.sha256(b";".join([told[j] for j in ids[cuts[i] : cuts[i + 1]].tolist()])).hexdigest() for i in range(n)]
            keep = ~bad[owner]
            doc, chunk, times = summed(owner[keep], ids[keep], np.ones(int(keep.sum()), np.int64), len(pair.groups))
            at, each = pair.pairs_of(chunk)
            codes, local = np.unique(pair.code[at], return_inverse=True)
            doc, local, times = summed(np.repeat(doc, each), local.astype(np.int64), pair.times[at] * np.repeat(times, each), len(codes))
            held = np.bincount(local, minlength=len(codes))
            step = np.diff(local, prepend=0)
            step[np.flatnonzero(np.diff(doc, prepend=-1))] = local[np.flatnonzero(np.diff(doc, prepend=-1))]
            packed = packer.compress(np.concatenate([[n], np.bincount(doc, minlength=n), step, times]).astype("<i8").tobytes())
            rows = pa.RecordBatch.from_arrays([part.column(key), *[pa.array(sums[:, k]) for k in range(4)], pa.array(shas, pa.string())], ["key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
            whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            yield pa.RecordBatch.from_arrays([pa.array([task + number]), pa.array([as_bytes(rows)], pa.binary()), whole(pa.array(codes, pa.int64())), whole(pa.array(held, pa.int64())), pa.array([packed], pa.binary())], ["slice", "docs", "pairs", "held", "packed"])

    return docs.select(key, text).mapInArrow(run, "slice long, docs binary, pairs array<long>, held array<long>, packed binary")


def each_pair(slices: DataFrame) -> DataFrame:
    return slices.select("slice", F.posexplode(F.arrays_zip("pairs", "held")).alias("at", "x")).select("slice", "at", F.col("x.pairs").alias("pair"), F.col("x.held").alias("held"))


def summed_pairs(slices: DataFrame) -> DataFrame:
    """pair, documents: corpus-wide."""
    return each_pair(slices).groupBy("pair").agg(F.sum("held").alias("documents"))


def pair_counts(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """a, b, documents, best: how many documents hold each linked id pair; whether no other partner of the A id is held by more."""
    counts = summed_pairs(sliced(docs, a_path, b_path, key, text)).select(F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("b"), "documents")
    counts = stored(counts, "pair-counts")
    return counts.join(counts.groupBy("a").agg(F.max("documents").alias("most")), "a").select("a", "b", "documents", (F.col("documents") == F.col("most")).alias("best"))


def groups(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, groups array<struct<a array<int>, b array<int>>> of each row: the ids of each minimal group, in order."""
    sent = docs.sparkSession.sparkContext.broadcast((contents(a_path), contents(b_path)))
    kind = docs.schema[key].dataType.simpleString()
    ids = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in gathered(batches, text, SLICE // 4):
            pair = pair_of(*sent.value)
            out = []
            for t in part.column(text).to_pylist():
                numbers = pair.numbers(chunks := pair.chunks(t))
                told = b";".join([pair.groups[i] for i in numbers.tolist()]) if chunks and pair.good[numbers].all() else b""
                out.append([dict(zip("ab", [[int(i) for i in s.split(b",")] for s in g.split(b"|")], strict=True)) for g in told.split(b";")] if told else [])
            yield pa.RecordBatch.from_arrays([part.column(key), pa.array(out, pa.list_(pa.struct([("a", ids), ("b", ids)])))], [key, "groups"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, groups array<struct<a: array<int>, b: array<int>>>")


def align(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row. The result is written to the shared folder."""
    kind = docs.schema[key].dataType.simpleString()
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        held, at, value = None, [], []

        def result() -> pa.RecordBatch:
            rows, packed = held
            flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), "<i8")
            n = int(flat[0])
            each = flat[1 : n + 1]
            step, times = np.split(flat[n + 1 :], 2)
            doc = np.repeat(np.arange(n), each)
            # Steps begin anew in each document.
            total = np.cumsum(step)
            first = np.cumsum(each) - each
            local = total - np.repeat((total - step)[np.minimum(first, max(0, len(step) - 1))] if len(step) else first, each)
            known = np.zeros(int(local.max(initial=-1)) + 1, np.int64)
            if at:
                known[np.concatenate(at)] = np.concatenate(value)
            found = known[local]
            sums = [np.zeros(n, np.int64), np.zeros(n, np.int64)]
            np.add.at(sums[0], doc, times * (found & 1))
            np.add.at(sums[1], doc, times * (found >> 1))
            told = pa.ipc.open_stream(rows).read_next_batch()
            return pa.RecordBatch.from_arrays([*[told.column(c) for c in ("key", *names[:4])], pa.array(sums[0]), pa.array(sums[1]), told.column("groups_sha256")], ["key", *names])

        for b in batches:
            is_head = b.column("at").to_numpy() < 0
            heads = np.flatnonzero(is_head)
            cuts = [0, *heads.tolist(), b.num_rows]
            for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
                if begin == end:
                    continue
                if is_head[begin]:
                    if held is not None:
                        yield result()
                    held, at, value = (b.column("docs")[begin].as_py(), b.column("packed")[begin].as_py()), [], []
                    begin += 1
                at.append(b.column("at").slice(begin, end - begin).to_numpy())
                value.append(b.column("value").slice(begin, end - begin).to_numpy())
        if held is not None:
            yield result()

    with scratch(docs.sparkSession):
        slices = stored(sliced(docs, a_path, b_path, key, text), "slices")
        counts = stored(summed_pairs(slices), "pair-counts")
        # One row for each id of A at the most: its vocabulary bounds what is broadcast.
        most = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("documents").alias("most"))
        values = counts.join(F.broadcast(most), F.shiftright("pair", 32) == F.col("a")).select("pair", (F.col("documents") * 2 + (F.col("documents") == F.col("most")).cast("long")).alias("value"))
        heads = slices.select("slice", F.lit(-1).alias("at"), F.lit(0).cast("long").alias("value"), "docs", "packed")
        empty = [F.lit(None).cast(heads.schema[c].dataType).alias(c) for c in ("docs", "packed")]
        known = each_pair(slices).select("slice", "at", "pair").join(values.hint("merge"), "pair").select("slice", "at", "value", *empty)
        # One number is sorted by, which takes Spark less time than two columns: a slice's head, then its pairs in any order.
        both = heads.unionByName(known).repartition("slice").sortWithinPartitions(F.shiftleft("slice", 1) + (F.col("at") >= 0).cast("long"))
        out = both.select("at", "value", "docs", "packed").mapInArrow(run, f"key {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
        return stored(out.withColumnRenamed("key", key), "aligned", keep=True)


def op11_cross_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
