"""Importance resampling towards a target: hashed runs of words, a gain for each bucket, Gumbel noise by key, the best share is drawn.

Each task keeps a trie of words. A node is a run of words; it holds how often the run was met and the state of CRC-32 after it, from which
the states of its children go on, so no run is ever put together. A trie that has MOST_NODES nodes gives out its bucket totals and
begins anew; the totals of all tasks are summed. A bucket's gain compares its share of the target with its share of the documents. To
score documents, tries are walked again, with the gain of its bucket attached to each node.

Drawn rows are numbered without a global window: sorted ranges are written, and each range begins after the rows of those before it.

Defined results: words are runs of ASCII letters and digits and of all beyond ASCII, A to Z lower-cased. NULL, empty and wordless texts
have no features and weight 0; they have a score but, having fewer than LEAST_WORDS words, no rank. A NULL key counts as empty text and comes
last among equal scores. Rows that repeat key and text have one score and adjacent ranks. A very long text is a slice of its own. Empty documents give no
rows; an empty target has every share equal. Other columns are read only if they are to be kept.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import gathered, read, stored

RUN, BUCKETS, SEED, PERCENT, LEAST_WORDS = 1, 10_000, 2024, 10, 20
#: Nodes that a trie has before it gives out its totals, or is forgotten.
MOST_NODES = 300_000

_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


def features_in(words: int, run: int) -> int:
    """How many runs of one to `run` words there are."""
    return sum(max(0, words - k) for k in range(run))


class Node(dict):
    """A run of words: its children by word, the CRC state after it, how often it was met, its bucket's gain."""

    __slots__ = ("count", "crc", "gain", "trie")

    def __init__(self, trie: Trie, crc: int) -> None:
        self.trie, self.crc, self.count = trie, crc, 0
        self.gain = trie.gains[crc % trie.buckets] if trie.gains else 0

    def __missing__(self, word: bytes) -> Node:
        self.trie.nodes += 1
        self[word] = child = Node(self.trie, zlib.crc32(word if self is self.trie.root else b" " + word, self.crc))
        return child


class Trie:
    """The runs of one to `run` words of the texts that it was given."""

    def __init__(self, run: int, buckets: int, gains: list[int] | None = None) -> None:
        self.run, self.buckets, self.gains = run, buckets, gains
        self.nodes = 0
        self.root = Node(self, 0)

    def met(self, words: list[bytes]) -> Iterator[tuple[Node, int]]:
        """The nodes of a text's runs, and how often it has each."""
        for k in range(self.run):
            for path, n in Counter(zip(*[words[j:] for j in range(k + 1)], strict=False)).items():
                node = self.root
                for word in path:
                    node = node[word]
                yield node, n

    def add(self, words: list[bytes]) -> None:
        for node, n in self.met(words):
            node.count += n

    def weight(self, words: list[bytes]) -> int:
        return sum(node.gain * n for node, n in self.met(words))

    def totals(self) -> tuple[np.ndarray, np.ndarray]:
        """Buckets that were met, and how often."""
        out = np.zeros(self.buckets, np.int64)
        open_nodes = [self.root]
        while open_nodes:
            node = open_nodes.pop()
            out[node.crc % self.buckets] += node.count
            open_nodes += node.values()
        met = np.flatnonzero(out)
        return met, out[met]


def bucket_totals(docs: DataFrame, text: str = "text", run: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: how many features of all texts fall into each bucket that has any."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(run, buckets)
        for part in gathered(batches, text):
            for t in part.column(text).to_pylist():
                trie.add(words_of(t))
                if trie.nodes > MOST_NODES:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in trie.totals()], ["bucket", "n"])
                    trie = Trie(run, buckets)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in trie.totals()], ["bucket", "n"])

    return docs.select(text).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains_of(source: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """floor(1000 ln(share of the target / share of the source)) of each bucket, each bucket counted once more."""
    s_all, t_all = float(sum(source.values()) + buckets), float(sum(target.values()) + buckets)
    return [math.floor(1000 * math.log((target.get(b, 0) + 1.0) * s_all / ((source.get(b, 0) + 1.0) * t_all))) for b in range(buckets)]


def noise(key: object, seed: int = SEED) -> int:
    """Gumbel noise of a key, in thousandths."""
    h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def learn(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", run: int = RUN, buckets: int = BUCKETS) -> list[int]:
    """The gain of each bucket; `buckets` rows of either side are collected at the most."""
    source, wanted = ({r.bucket: r.n for r in bucket_totals(df, c, run, buckets).collect()} for df, c in ((docs, text), (target, target_text)))
    return gains_of(source, wanted, buckets)


def scored(docs: DataFrame, gains: list[int], key: str = "doc_id", text: str = "text", run: int = RUN, seed: int = SEED, keep: Sequence[str] = ()) -> DataFrame:
    """_row, _key, _words, n_features, weight, score of each row, and the kept columns as _kept0, _kept1 and so on."""
    sent = docs.sparkSession.sparkContext.broadcast(gains)
    kinds = [docs.schema[c].dataType.simpleString() for c in (key, *keep)]
    carried = ["_key", *[f"_kept{i}" for i in range(len(keep))]]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row, known = TaskContext.get().partitionId() << 33, sent.value
        trie = Trie(run, len(known), known)
        for part in gathered(batches, "_text"):
            cols: list[list[int]] = [[], [], [], []]
            for k, t in zip(part.column("_key").to_pylist(), part.column("_text").to_pylist(), strict=True):
                words = words_of(t)
                weight = trie.weight(words)
                for col, x in zip(cols, (len(words), features_in(len(words), run), weight, weight + noise(k, seed)), strict=True):
                    col.append(x)
                if trie.nodes > MOST_NODES:
                    trie = Trie(run, len(known), known)
            rows = pa.array(range(row, row + part.num_rows), pa.int64())
            row += part.num_rows
            yield pa.RecordBatch.from_arrays([rows, *[part.column(c) for c in carried], *[pa.array(c, pa.int64()) for c in cols]], ["_row", *carried, "_words", "n_features", "weight", "score"])

    named = [F.col(c).alias(x) for c, x in zip((key, *keep), carried, strict=True)]
    schema = ", ".join(f"{c} {k}" for c, k in zip(carried, kinds, strict=True))
    return docs.select(*named, F.col(text).alias("_text")).mapInArrow(score, f"_row long, {schema}, _words long, n_features long, weight long, score long")


def ranked(rows: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows of scored() with their rank: NULL if not drawn."""
    rows = stored(rows, "scored")
    able = rows.where(F.col("_words") >= least_words)
    drawn = able.count() * percent // 100
    order = [F.col("score").desc(), F.col("_key").asc_nulls_last(), F.col("_row")]
    sorted_rows = able.repartitionByRange(*order).sortWithinPartitions(*order)
    # Within a task, the low 33 bits number its rows in their order.
    numbered = stored(sorted_rows.select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")), "ranked")
    sizes = numbered.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # a row for each shuffle partition at the most
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_begin"))
    place = F.col("_begin") + F.col("_at") + 1
    told = numbered.join(F.broadcast(begins), "_range").withColumn("rank", F.when(place <= drawn, place)).drop("_range", "_at", "_begin", "_n")
    return told.unionByName(rows.where(F.col("_words") < least_words).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", run: int = RUN, buckets: int = BUCKETS, seed: int = SEED, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """key, n_features, weight, score, rank of each row."""
    found = ranked(scored(docs, learn(docs, target, text, target_text, run, buckets), key, text, run, seed), percent, least_words)
    return found.select(F.col("_key").alias(key), "n_features", "weight", "score", "rank")


def drawn(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", **options: int) -> DataFrame:
    """The drawn rows of docs, as they came. options: as of resample()."""
    taken = {k: options.pop(k) for k in ("percent", "least_words") if k in options}
    gains = learn(docs, target, text, **{k: v for k, v in options.items() if k != "seed"})
    found = ranked(scored(docs, gains, key, text, keep=docs.columns, **{k: v for k, v in options.items() if k != "buckets"}), **taken)
    return found.where("rank IS NOT NULL").select(*[F.col(f"_kept{i}").alias(c) for i, c in enumerate(docs.columns)])


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


#: The same in SQL: CRC-32 of each distinct word, its table by rule.
ORACLE = f"""
WITH RECURSIVE crc_steps(i, k, v) AS (
    SELECT range, 0, range::BIGINT FROM range(256)
    UNION ALL
    SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM crc_steps WHERE k < 8
),
crc_table AS (SELECT list(v ORDER BY i) AS t FROM crc_steps WHERE k = 8),
doc_words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
item_words AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')) AS word FROM benchmark),
each_word AS (SELECT doc_id, unnest(w) AS word FROM doc_words),
counts AS (SELECT word, sum(s) AS s, sum(t) AS t FROM (SELECT word, 1 AS s, 0 AS t FROM each_word UNION ALL SELECT word, 0, 1 FROM item_words) GROUP BY word),
hashed AS (
    SELECT word, s, counts.t AS t, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(word)), '..'), lambda x: ('0x' || x)::BIGINT)),
               lambda c, b: xor(c >> 8, crc_table.t[(xor(c, b) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket
    FROM counts, crc_table
),
totals AS (SELECT sum(s)::DOUBLE + {BUCKETS} AS s_all, sum(t)::DOUBLE + {BUCKETS} AS t_all FROM hashed),
gains AS (SELECT bucket, floor(1000 * ln((sum(t) + 1)::DOUBLE * any_value(s_all) / ((sum(s) + 1)::DOUBLE * any_value(t_all))))::BIGINT AS gain FROM hashed, totals GROUP BY bucket),
weights AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM each_word JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY doc_id),
scores AS (
    SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
           (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))))::BIGINT AS score
    FROM doc_words LEFT JOIN weights USING (doc_id)
),
places AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scores WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN place <= {PERCENT} * n // 100 THEN place END AS rank FROM scores LEFT JOIN places USING (doc_id)
"""
