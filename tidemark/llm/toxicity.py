"""Toxicity scores by gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of a lexicon of words and of word stems, how near second-person words
stand to lexicon hits, shares of capitals, punctuation rates, and rates of obfuscated spellings (digits
and signs inside words, also read back as letters). The lexicon holds words and word beginnings that are
far more frequent in toxic documents of the training sample. CALIBRATION of the sample is set apart first: it
has no part in lexicon and trees, and only calibrates.

Learning uses a bounded sample: at most about MOST_TOXIC and MOST_CLEAN labelled rows, those with the
least key hashes, weighted back to the classes' sizes. Features and scores cover all rows and whole texts.

Defined results: NULL and empty texts are scored like any text, from features that are all 0; a label
NULL is no label; a key with several labels counts as toxic if one is; without labels of both classes
every score is the toxic share (0 without labels). Repeated rows get equal scores; a very long text is read whole. Columns other than
key and text are not read by a score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, drop_stored, gathered, keyed_uniform, read, stored

MOST_TOXIC, MOST_CLEAN = 4000, 6000
CALIBRATION = 0.25
LEXICON_SIZE, LEXICON_RATIO, LEXICON_GAIN = 400, 12.0, 16.0
STEMS = (4, 5, 6, 7)
TREES, DEPTH, RATE, BINS, LEAST_WEIGHT = 80, 3, 0.15, 64, 3.0
PREDICT_FROM = 0.3
NEAR = 5

WORD = re.compile(r"[^\W\d_]+")
MASKED = re.compile(r"[A-Za-z]+[0-9@$*!][A-Za-z0-9@$*!]*[A-Za-z]")
UNMASK = str.maketrans("013457@$!", "oieastasi")
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi vous votre ton ta usted tú ti tus su vosotros".split())
#: Common insults, in the lexicon of every model.
INSULTS = ("idiot", "moron", "imbecile", "stupid", "dumb", "loser", "scum", "trash", "garbage", "clown", "pathetic", "worthless", "disgusting", "jerk", "coward", "filth", "bastard")
FEATURES = ("words", "hits", "density", "stem_hits", "stem_density", "distinct", "near_you", "capitals", "shouted", "exclaimed", "punctuation", "masked", "masked_hits")


class Reader:
    """Features of texts, for one lexicon: words, and stems written with a leading '^'."""

    def __init__(self, lexicon: list[str]) -> None:
        self.words = {w for w in lexicon if w[0] != "^"}
        self.stems = {w[1:] for w in lexicon if w[0] == "^"}
        self.known: dict[str, int] = {}

    def kind(self, word: str) -> int:
        """1: a word of the lexicon; 2: it begins with a stem; 4: second person."""
        if len(self.known) > 1_000_000:
            self.known.clear()
        k = (word in self.words) + 2 * any(word[:n] in self.stems for n in STEMS if len(word) > n) + 4 * (word in SECOND_PERSON)
        self.known[word] = k
        return k

    def features(self, text: str) -> list[float]:
        if not text:
            return [0.0] * len(FEATURES)
        words = WORD.findall(text.lower())
        n = len(words)
        kinds = list(map(self.known.get, words))
        if None in kinds:
            kinds = [self.kind(w) if k is None else k for w, k in zip(words, kinds, strict=True)]
        hits = sum(k & 1 for k in kinds) if 1 in kinds or 3 in kinds or 5 in kinds or 7 in kinds else 0
        stems = sum(k >> 1 & 1 for k in kinds) if 2 in kinds or 3 in kinds or 6 in kinds or 7 in kinds else 0
        distinct = near = 0
        if hits or stems:
            at = [i for i, k in enumerate(kinds) if k & 3]
            distinct = len({words[i] for i in at})
            near = sum(any(k & 4 for k in kinds[max(0, i - NEAR) : i + NEAR + 1]) for i in at)
        length = len(text)
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        counts = np.bincount(raw, minlength=128)
        capitals = int(counts[65:91].sum())
        punctuation = int(counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum())
        shouted = sum(map(str.isupper, text.split())) if capitals > 0.1 * length else 0
        masked = masked_hits = 0
        if counts[48:58].any() or counts[[33, 36, 42, 64]].any():
            found = MASKED.findall(text)
            masked = len(found)
            masked_hits = sum(bool(self.kind(w.lower().translate(UNMASK)) & 3) for w in found)
        per = max(n, 1)
        return [float(np.log1p(n)), hits, 100 * hits / per, stems, 100 * stems / per, distinct, 100 * near / per, capitals / length, shouted / per, 100 * float(counts[33]) / length, punctuation / length, 100 * masked / per, masked_hits]


class Trees:
    """Boosted regression trees for logistic loss, on quantile bins."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = self.binned(x)
        share = np.average(y, weights=weight)
        self.start = float(np.log(share / (1 - share)))
        score = np.full(len(y), self.start)
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            tree = self.grown(binned, weight * (y - p), weight * p * (1 - p))
            self.trees.append(tree)
            score += self.leaf(tree, binned)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, v, "right") for c, v in zip(self.cuts, x.T, strict=True)], 1).astype(np.int64)

    def grown(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = 2 ** (DEPTH + 1) - 1
        feature, cut, value = np.full(size, -1), np.zeros(size, np.int64), np.zeros(size)
        node = np.zeros(len(b), np.int64)
        for at in range(size):
            mine = np.flatnonzero(node == at)
            if not len(mine):
                continue
            sg, sh = g[mine].sum(), h[mine].sum()
            value[at] = RATE * sg / (sh + 1.0)
            if at >= 2**DEPTH - 1:
                continue
            best = 1e-6
            for f in range(b.shape[1]):
                left_g = np.cumsum(np.bincount(b[mine, f], g[mine], BINS))[:-1]
                left_h = np.cumsum(np.bincount(b[mine, f], h[mine], BINS))[:-1]
                gain = left_g**2 / (left_h + 1.0) + (sg - left_g) ** 2 / (sh - left_h + 1.0) - sg**2 / (sh + 1.0)
                gain[(left_h < LEAST_WEIGHT) | (sh - left_h < LEAST_WEIGHT)] = 0
                k = int(gain.argmax())
                if gain[k] > best:
                    best, feature[at], cut[at] = gain[k], f, k
            if feature[at] >= 0:
                node[mine] = 2 * at + 1 + (b[mine, feature[at]] > cut[at])
        return feature, cut, value

    @staticmethod
    def leaf(tree: tuple[np.ndarray, np.ndarray, np.ndarray], b: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        node = np.zeros(len(b), np.int64)
        for _ in range(DEPTH):
            f = feature[node]
            go = f >= 0
            node[go] = 2 * node[go] + 1 + (b[go, f[go]] > cut[node[go]])
        return value[node]

    def probability(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        score = np.full(len(b), self.start)
        for tree in self.trees:
            score += self.leaf(tree, b)
        return 1 / (1 + np.exp(-score))


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (mean x, mean y) of the blocks, ascending."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for a, b, w in zip(x[order].tolist(), y[order].tolist(), weight[order].tolist(), strict=True):
        blocks.append([a * w, b * w, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    done = np.array(blocks)
    return done[:, 0] / done[:, 2], done[:, 1] / done[:, 2]


class Model:
    def __init__(self, lexicon: list[str], constant: float, trees: Trees | None = None, knots: tuple | None = None) -> None:
        self.lexicon, self.constant, self.trees, self.knots = lexicon, constant, trees, knots

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.constant)
        raw = self.trees.probability(x)
        # A hundredth of the trees' own probability keeps the order within a calibrated block.
        return np.clip(0.99 * np.interp(raw, *self.knots) + 0.01 * raw, 0, 1)


def lexicon_of(sample: DataFrame, text: str, label: str) -> list[str]:
    """Words and stems whose share of toxic documents is LEXICON_RATIO times that of the others; those that say most first.

    Weight is documents times log ratio; LEXICON_GAIN of it keeps out words that are rare in either class."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}]+"), lambda w: F.length(w) > 2)
    stems = [F.transform(F.filter("w", lambda w, n=n: F.length(w) > n), lambda w, n=n: F.concat(F.lit("^"), F.substring(w, 1, n))) for n in STEMS]
    terms = sample.select(F.col(label).alias("y"), F.array_distinct(words).alias("w")).select("y", F.explode(F.array_distinct(F.concat("w", *stems))).alias("term"))
    n = {r["y"]: r["n"] for r in sample.groupBy(F.col(label).alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if n.keys() < {0, 1}:
        return sorted(INSULTS)
    counts = terms.groupBy("term").agg(F.count_if(F.col("y") == 1).alias("bad"), F.count_if(F.col("y") == 0).alias("good"))
    ratio = (F.col("bad") / n.get(1, 1)) / ((F.col("good") + 0.5) / n.get(0, 1))
    gained = counts.where("bad > 2").withColumn("ratio", ratio).where(F.col("ratio") >= LEXICON_RATIO).withColumn("gain", F.col("bad") * F.log("ratio")).where(F.col("gain") >= LEXICON_GAIN)
    rows = gained.orderBy(F.desc("gain"), "term").limit(LEXICON_SIZE).collect()
    return sorted({r["term"] for r in rows} | set(INSULTS))


def feature_rows(docs: DataFrame, lexicon: list[str], key: str, text: str, model: Model | None = None) -> DataFrame:
    """key with its features (model None) or its score."""
    sent = docs.sparkSession.sparkContext.broadcast((lexicon, model))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, fitted = sent.value
        reader = Reader(words)
        for part in gathered(batches, text):
            x = np.array([reader.features(t or "") for t in part.column(text).to_pylist()], np.float64).reshape(-1, len(FEATURES))
            value = pa.array(x.tolist(), pa.list_(pa.float64())) if fitted is None else pa.array(fitted.scores(x), pa.float64())
            yield pa.RecordBatch.from_arrays([part.column(key), value], ["key", "value"])

    return docs.select(key, text).mapInArrow(run, f"key {kind}, value {'array<double>' if model is None else 'double'}")


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.max(F.when(F.col(label) > 0, 1).otherwise(0)).alias("_y"))
    sizes = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad or not good:
        return Model([], bad / max(1, bad + good))
    rate = F.when(F.col("_y") == 1, min(1.1, MOST_TOXIC / bad)).otherwise(min(1.1, MOST_CLEAN / good))
    some = known.where(keyed_uniform(F.col("_k")) < rate)
    # Bounded by MOST_TOXIC and MOST_CLEAN, whatever the tables hold: of rows that repeat a key, the least text counts.
    sample = stored(docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")).join(F.broadcast(some), "_k").groupBy("_k", "_y").agg(F.min("_t").alias("_t")).select(F.col("_k").alias(key), F.col("_t").alias(text), "_y"), "labelled")
    apart = keyed_uniform(F.col(key), F.lit("calibrate"))
    lexicon = lexicon_of(sample.where(apart >= CALIBRATION), text, "_y")
    got = feature_rows(sample, lexicon, key, text).join(F.broadcast(some), F.col("key") == F.col("_k")).select("key", "value", "_y", keyed_uniform(F.col("key"), F.lit("calibrate")).alias("u")).orderBy("key", "value").collect()
    drop_stored(sample)
    if not got:
        return Model([], bad / (bad + good))
    x, y = np.array([r["value"] for r in got]), np.array([r["_y"] for r in got], np.float64)
    weight = np.where(y == 1, max(1.0, bad / MOST_TOXIC), max(1.0, good / MOST_CLEAN))
    weight /= weight.mean()
    held = np.array([r["u"] for r in got]) < CALIBRATION
    if len(set(y[~held])) < 2 or len(set(y[held])) < 2:
        held = np.zeros(len(y), bool)
    if len(set(y)) < 2:
        return Model([], bad / (bad + good))
    trees = Trees(x[~held], y[~held], weight[~held])
    over = held if held.any() else ~held
    return Model(lexicon, bad / (bad + good), trees, isotonic(trees.probability(x[over]), y[over], weight[over]))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score, predicted of each row."""
    return feature_rows(docs, model.lexicon, key, text, model).select(F.col("key").alias(key), F.col("value").alias("score"), (F.col("value") >= PREDICT_FROM).cast("int").alias("predicted"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = learn(docs, read(spark, sf_dir, "labels").where(crc_mod("doc_id", 4) != 2))
    return score(docs, model).withColumn("held_out", crc_mod("doc_id", 4) == 2)
