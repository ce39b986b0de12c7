"""Document fingerprints by randomised edit embedding, with bit-sampled bands and verification.

A shared random walk reads a text: at step j it stands on a character, emits it, and moves on if the
shared bit of (j, character) is 1. Texts a few edits apart meet again soon after each edit, so edit
distance becomes Hamming distance between the emitted strings. A fingerprint holds SAMPLES emitted
characters of each of WALKS walks, hashed to four bits. Where a sample lies in a string of N steps is
the place below N with the least shared hash: strings of about the same length sample the same places.

All texts of a slice walk in step as vectors: a table gives the steps spent on a character from the
step's phase (the bits repeat after PERIOD steps). The edited text shares its head with the text, and
so its walk.

Defined results: NULL counts as the empty text; all empty texts have one fingerprint; equal texts have
equal fingerprints; rows are ordered by doc_id, NULL ids first, and rows that repeat an id by a hash of their text,
one after another; the row after the last is the first; in a table of one row that is the row itself; a very long
text is walked whole, in a slice of its own.
Columns other than key and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_ROWS, read, slices, stored

WALKS, SAMPLES, PERIOD, CLASSES = 2, 128, 4096, 256
SLICE = 6_000_000
#: Share of equal samples between unrelated texts: a letter's chance to meet itself, or its four bits another's.
CHANCE = 0.125
#: Below so many texts at one step, they walk one by one.
FEW = 20
#: Samples in a band of the pair search, taken from one walk; neighbours within a band's order that are candidates.
BAND, NEIGHBOURS = 4, 2
#: Share of equal samples, of all walks, below which a candidate is not verified: six standard deviations above chance.
LEAST_ALIKE = 0.25


def _bits(tag: str, n: int) -> np.ndarray:
    """n shared random bytes, the same on every machine."""
    return np.frombuffer(hashlib.shake_256(f"tidemark edit walk {tag}".encode()).digest(n), np.uint8)


class Walks:
    def __init__(self) -> None:
        bits = (_bits("move", WALKS * CLASSES * PERIOD).reshape(WALKS, CLASSES, PERIOD) & 1).astype(bool)
        bits[:, :, -1] = True  # the walk moves at the end of each period at the latest
        steps = np.empty((WALKS, CLASSES, PERIOD), np.uint8)
        run = np.zeros((WALKS, CLASSES), np.int64)
        for p in range(PERIOD - 1, -1, -1):
            run = np.where(bits[:, :, p], 1, run + 1)
            steps[:, :, p] = np.minimum(run, 255)
        self.steps = steps.reshape(-1)
        self.rows = [steps[w].tobytes() for w in range(WALKS)]
        self.nibble = (_bits("symbol", WALKS * SAMPLES * CLASSES) & 15).reshape(WALKS, SAMPLES, CLASSES)
        self.nothing = (_bits("nothing", WALKS * SAMPLES) & 15).reshape(WALKS, SAMPLES)
        self.places = self._places()
        self.base = (np.arange(WALKS, dtype=np.int64) * CLASSES * PERIOD)[:, None]

    def _places(self) -> np.ndarray:
        """For each walk and sample, the places that have the least hash so far, ascending."""
        u = (np.frombuffer(hashlib.shake_256(b"tidemark edit walk places").digest(WALKS * SAMPLES * 128 * 8), np.uint64).reshape(WALKS, SAMPLES, 64, 2) >> np.uint64(11)).astype(np.float64) / 2**53
        out = np.zeros((WALKS, SAMPLES, 64), np.int64)
        least = np.maximum(u[:, :, 0, 1], 1e-12)
        for r in range(1, 64):
            gap = np.floor(np.log(np.maximum(u[:, :, r, 0], 1e-300)) / np.log1p(-np.minimum(least, 1 - 1e-12))) + 1
            out[:, :, r] = np.minimum(out[:, :, r - 1] + np.minimum(gap, 2.0**45), 2**50).astype(np.int64)
            least = np.maximum(least * u[:, :, r, 1], 1e-12)
        return out

    @staticmethod
    def classes(text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        out = points.astype(np.uint8)
        high = points > 127
        if high.any():
            out[high] = (128 + ((points[high].astype(np.uint64) * np.uint64(2654435761)) >> np.uint64(13)) % 128).astype(np.uint8)
        return out

    def walk(self, codes: list[np.ndarray], begin: np.ndarray) -> list[np.ndarray]:
        """Steps done after each character, (WALKS, length) for each text; begin: steps done before, (texts, WALKS)."""
        n = np.fromiter(map(len, codes), np.int64, len(codes))
        order = np.argsort(-n, kind="stable")
        longest = int(n.max(initial=0))
        if not longest:
            return [np.empty((WALKS, 0), np.int32) for _ in codes]
        ascending = n[order][::-1]
        active = len(codes) - np.searchsorted(ascending, np.arange(longest), "right")
        together = int(np.searchsorted(-active, -FEW, "right")) if len(codes) >= FEW else 0
        m = active[:together]
        at = np.concatenate([[0], np.cumsum(m)])
        flat = np.empty(int(at[-1]), np.int64)
        for d, i in enumerate(order):
            k = min(int(n[i]), together)
            flat[at[:k] + d] = codes[i][:k]
        flat *= PERIOD
        done = np.empty((WALKS, len(flat)), np.int32)
        j = np.ascontiguousarray(begin[order].T).astype(np.int64)
        table, base, mask = self.steps, self.base, PERIOD - 1
        places, counts = at.tolist(), m.tolist()
        index, gap, width = np.empty_like(j), np.empty(j.shape, np.uint8), -1
        for i in range(together):
            k, s = counts[i], places[i]
            if k != width:
                now, at_, step, width = j[:, :k], index[:, :k], gap[:, :k], k
            np.bitwise_and(now, mask, out=at_)
            at_ += base
            at_ += flat[s : s + k]
            table.take(at_, out=step, mode="wrap")
            now += step
            done[:, s : s + k] = now
        out: list = [None] * len(codes)
        for d, i in enumerate(order):
            k = min(int(n[i]), together)
            mine = done[:, at[:k] + d]
            if k < n[i]:
                rest = np.empty((WALKS, int(n[i]) - k), np.int32)
                tail = codes[i][k:].tobytes()
                for w in range(WALKS):
                    row, x, got = self.rows[w], int(j[w, d]), []
                    for c in tail:
                        x += row[c << 12 | x & mask]
                        got.append(x)
                    rest[w] = got
                mine = np.concatenate([mine, rest], 1)
            out[i] = mine
        return out

    def digest(self, codes: np.ndarray, done: np.ndarray) -> np.ndarray:
        """Four bits of each sample, (WALKS, SAMPLES)."""
        if not len(codes):
            return self.nothing
        out = np.empty((WALKS, SAMPLES), np.uint8)
        for w in range(WALKS):
            total = int(done[w, -1])
            which = (self.places[w] < total).sum(1) - 1
            p = self.places[w][np.arange(SAMPLES), which]
            c = codes[np.searchsorted(done[w], p, "right")]
            out[w] = self.nibble[w, np.arange(SAMPLES), c]
        return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Of the walk that agrees best: its share of equal samples beyond chance."""
    best = float((a == b).mean(1).max())
    return max(0.0, (best - CHANCE) / (1 - CHANCE))


HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def as_text(nibbles: np.ndarray) -> str:
    return HEX[nibbles.reshape(-1)].tobytes().decode()


_walks: list[Walks] = []


def walks() -> Walks:
    if not _walks:
        _walks.append(Walks())
    return _walks[0]


def edited(text: str, following: str) -> str:
    """The last quarter of the text's characters gives way to the first as many of the following text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def in_order(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, text in ranges of (key, hash of the text), each sorted: one shuffle of the texts. Rows that repeat an id are split by
    their texts; how many ranges there are follows from the session, and nothing about them comes to the driver."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("th"))
    return rows.repartitionByRange(F.col("key").asc_nulls_first(), "th").sortWithinPartitions(F.col("key").asc_nulls_first(), "th").select("key", "text")


FINISHED, FIRST, LAST = 0, 1, 2


def fingerprint(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row.

    A range is walked row by row with its follower. Its last row's follower is the first row of the next range that has rows:
    the two outermost rows of each range are written beside the results, and met by the ranges' numbers."""
    kind = docs.schema[key].dataType.simpleString()
    spark = docs.sparkSession
    results = f"key {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    fields = results + ", state int, range int, text string"
    names = [x.split()[0] for x in fields.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.string()]

    def packed(rows: list[tuple], arrow_key: pa.DataType) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [arrow_key, *kinds], strict=True)], names)

    def made(keys: list, texts: list[str]) -> list[tuple]:
        """Results of all rows but the last, which only follows."""
        w = walks()
        n = range(len(texts) - 1)
        codes = [w.classes(t) for t in texts]
        done = w.walk(codes, np.zeros((len(texts), WALKS), np.int64))
        prints = [w.digest(c, d) for c, d in zip(codes, done, strict=True)]
        heads = [len(codes[i]) - len(codes[i]) // 4 for i in n]
        tails = [codes[i + 1][: len(codes[i]) // 4] for i in n]
        begin = np.array([done[i][:, h - 1] if h else np.zeros(WALKS, np.int64) for i, h in zip(n, heads, strict=True)], np.int64).reshape(len(n), WALKS)
        out = []
        for i, h, tail, rest in zip(n, heads, tails, w.walk(tails, begin), strict=True):
            mine = prints[i]
            other = mine if len(codes[i]) < 4 else w.digest(np.concatenate([codes[i][:h], tail]), np.concatenate([done[i][:, :h], rest], 1))
            sha = hashlib.sha256(edited(texts[i], texts[i + 1]).encode("utf-8", "surrogatepass")).hexdigest()
            out.append((keys[i], len(codes[i]), sha, as_text(mine), as_text(other), likeness(mine, other), likeness(mine, prints[i + 1]), FINISHED, 0, None))
        return out

    def border(state: int, at: int, k: object, t: str) -> tuple:
        return (k, None, None, None, None, None, None, state, at, t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = TaskContext.get().partitionId()
        keys: list = []
        texts: list[str] = []
        size, begun, arrow_key = 0, False, pa.null()
        for part in slices(batches, "text", SLICE):
            arrow_key = part.schema.field("key").type
            for k, t in zip(part.column("key").to_pylist(), part.column("text").to_pylist(), strict=True):
                if not begun:
                    begun = True
                    yield packed([border(FIRST, at, k, t or "")], arrow_key)
                keys.append(k)
                texts.append(t or "")
                size += len(texts[-1])
                if len(keys) > 1 and (size > SLICE or len(keys) > SLICE_ROWS):
                    yield packed(made(keys, texts), arrow_key)
                    keys, texts, size = keys[-1:], texts[-1:], len(texts[-1])
        if begun:
            yield packed([*made(keys, texts), border(LAST, at, keys[-1], texts[-1])], arrow_key)

    found = stored(in_order(docs, key, text).mapInArrow(run, fields), "fingerprints")
    edges = found.where(f"state <> {FINISHED}")
    ranges = sorted(r[0] for r in edges.where(f"state = {LAST}").select("range").collect())
    after = spark.createDataFrame(list(zip(ranges, ranges[1:] + ranges[:1], strict=True)), "range int, following int")
    follow = edges.where(f"state = {FIRST}").select(F.col("range").alias("following"), F.col("text").alias("next_text"))
    met = edges.where(f"state = {LAST}").select("key", "text", "range").join(after, "range").join(follow, "following").select("key", "text", "next_text")

    def bridged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE):
            rows = [made([k, None], [t, u])[0] for k, t, u in zip(*[part.column(c).to_pylist() for c in ("key", "text", "next_text")], strict=True)]
            yield packed(rows, part.schema.field("key").type)

    every = found.where(f"state = {FINISHED}").unionByName(met.mapInArrow(bridged, fields))
    return every.select(*[F.col(x.split()[0]) for x in results.split(", ")]).withColumnRenamed("key", key)


def bands(prints: F.Column | str) -> F.Column:
    """Bit samples of fingerprints as text: the number of a band, then its BAND samples of four bits."""
    digits = F.col(prints) if isinstance(prints, str) else prints
    begins = [w * SAMPLES + k * BAND for w in range(WALKS) for k in range(SAMPLES // BAND)]
    return F.transform(F.array(*map(F.lit, begins)), lambda i: F.concat(i.cast("string"), F.lit(":"), F.substring(digits, i + 1, F.lit(BAND))))


def edit_distance_within(a: str, b: str, most: int) -> int | None:
    """Levenshtein distance if it is at most `most`: furthest-reaching points by diagonal, O((n + m) + most^2) compares."""
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return None

    def slide(i: int, j: int) -> int:
        step, k = 16, 0
        while True:
            x, y = a[i + k : i + k + step], b[j + k : j + k + step]
            if x == y and len(x) == step:
                k += step
                step *= 2
                continue
            for p, q in zip(x, y, strict=False):
                if p != q:
                    return k
                k += 1
                if k % 64 == 0 and a[i + k : i + k + 64] == b[j + k : j + k + 64]:
                    break
            else:
                return k
            step = 16

    reach = {0: slide(0, 0)}
    for d in range(most + 1):
        if reach.get(m - n, -1) >= n:
            return d
        nxt = {}
        for diag in range(-d - 1, d + 2):
            i = max(reach.get(diag, -2) + 1, reach.get(diag + 1, -2) + 1, reach.get(diag - 1, -2))
            if i < 0 or i > n or i + diag > m or i + diag < 0:
                if not (0 <= min(i, n, m - diag)):
                    continue
                i = min(i, n, m - diag)
                if i < 0 or i + diag < 0:
                    continue
            nxt[diag] = i + slide(i, i + diag)
        reach = nxt
    return None


def near_links(docs: DataFrame, share: float = 0.1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Verified links (a, b, distance) between texts at most share * longer length edits apart.

    Equal texts are one class, for which its least key stands. In each band the texts of a bucket are ordered by fingerprint and
    key, and each is a candidate with the bucket's least key and with its NEIGHBOURS predecessors in that order: what
    differs from the least may be near its neighbours, in some of the bands. A bucket gives as many candidates
    as it has texts, times a constant, at any size; its order is made of fingerprints alone, in tasks that split by fingerprint
    ranges. Texts travel once for each candidate; tests measure what share of brute-force links the links' classes hold."""
    # Bits of the text's hash stand for it where a text is grouped: the text itself moves once.
    classes = docs.where(F.col(text).isNotNull()).groupBy(F.sha2(F.encode(text, "UTF-8"), 256).alias("h")).agg(F.min(key).alias(key), F.min(text).alias(text))
    prints = stored(fingerprint(classes.select(key, text), key, text).select(F.col(key).alias("id"), "n_chars", "fingerprint"), "prints")
    buckets = prints.select("id", "fingerprint", F.explode(bands("fingerprint")).alias("band"))
    firsts = buckets.groupBy("band").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "first")
    stars = buckets.join(firsts, "band").where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    kind = docs.schema[key].dataType.simpleString()

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for part in batches:
            a, b = [], []
            for band, k in zip(part.column("band").to_pylist(), part.column("id").to_pylist(), strict=True):
                held = [x for x in held if x[0] == band][-NEIGHBOURS:]
                a += [x[1] for x in held]
                b += [k] * len(held)
                held.append((band, k))
            yield pa.RecordBatch.from_arrays([pa.array(a, part.schema.field("id").type), pa.array(b, part.schema.field("id").type)], ["a", "b"])

    order = ["band", "fingerprint", "id"]
    beside = buckets.repartitionByRange(*order).sortWithinPartitions(*order).select("band", "id").mapInArrow(neighbours, f"a {kind}, b {kind}")
    pairs = stars.unionByName(beside).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    side = lambda x: prints.select(F.col("id").alias(x), F.col("n_chars").alias(f"n{x}"), F.col("fingerprint").alias(f"f{x}"))
    equal = F.size(F.filter(F.sequence(F.lit(1), F.lit(WALKS * SAMPLES)), lambda i: F.substring("fa", i, F.lit(1)) == F.substring("fb", i, F.lit(1))))
    near = (F.abs(F.col("na") - F.col("nb")) <= share * F.greatest("na", "nb")) & (equal >= LEAST_ALIKE * WALKS * SAMPLES)
    close = pairs.join(side("a"), "a").join(side("b"), "b").where(near).select("a", "b")
    texts = classes.select(F.col(key).alias("id"), F.col(text).alias("t"))
    both = close.join(texts.select(F.col("id").alias("b"), "t"), "b").join(texts.select(F.col("id").alias("a"), F.col("t").alias("u")), "a")

    @F.pandas_udf("int")
    def distance(t, u):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series([edit_distance_within(x, y, int(share * max(len(x), len(y)))) for x, y in zip(t, u, strict=True)], dtype="Int32")

    return both.select("a", "b", distance("t", "u").alias("distance")).where("distance IS NOT NULL")


def op1_edit_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint(read(spark, sf_dir, "documents"))
