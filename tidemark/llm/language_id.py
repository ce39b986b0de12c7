"""Language identification by compression with per-language dictionaries.

Every learned language has a raw-content zstandard dictionary of sample text. A text is cut into blocks;
each block is compressed with each dictionary, and the language whose compressed blocks are smallest in
total is predicted. A text of one block is too short for that, because zstandard stores what it can make
little of as it is, in the same bytes for all languages: it is compressed behind the end of the dictionary, at
a higher level, and the bytes of that end alone are taken off. A text is rejected when the second smallest
total is close to the smallest, or when it has no letter at all. drop_rejected keeps a text of one block
whose best totals are equal: that is no evidence against it, such as a single word that no dictionary has.

Learning uses a bounded sample: DOCS_PER_LANGUAGE rows of each language, those with the least key hash (rows without a key go by
their text; of rows that repeat a key the least text counts), and DICTIONARY_BYTES of each dictionary, taken in equal shares from them. Everything else covers all rows.

Defined results: a NULL text and one without a letter are `und`, score 0, rejected; ties between
languages go to the first in sort order; rows without a lang are not learned from; without any labelled
row every text is `und`, and drop_rejected, which then knows no language, keeps all rows that have a letter. Very long
texts are compressed whole, block by block. Repeated rows are predicted alike. No other column of the input is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc_mod, gathered, keyed_uniform, read

DOCS_PER_LANGUAGE = 256
DICTIONARY_BYTES = 96 * 1024
#: Dictionaries are broadcast (24 MB at the most); a column with more values is no language label.
MOST_LANGUAGES = 256
#: Characters that are taken from one place of a sampled text, about.
PIECE = 96
BLOCK = 1024
LEVEL = 5
#: For texts of one block: the level, and the bytes of the dictionary's end that they are put behind.
SHORT_LEVEL = 12
TAIL = 256
#: Rejected if second / best - 1 of the compressed totals is below this.
MARGIN = 0.01
UNKNOWN = "und"


def learn(docs: DataFrame, label: str = "lang", key: str = "doc_id", text: str = "text", per_language: int = DOCS_PER_LANGUAGE, size: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """A dictionary for each label: equal shares of the sampled texts, from all over each text."""
    rows = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().limit(MOST_LANGUAGES + 1).collect()}
    if not counts:
        return {}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} labels: their dictionaries are sent to every worker")
    # One scan: the share of rows that gives twice those needed, then the least hashes of these.
    rate = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.1, 2.0 * per_language / n))])
    # Rows without a key go by their text; of rows of one key and label the least text counts, before they move.
    named = [F.col(key).cast("string"), F.when(F.col(key).isNull(), F.col(text))]
    hashed = rows.select(F.col(label).alias("label"), F.col(text).alias("text"), F.when(F.col(key).isNull(), F.xxhash64(*named)).otherwise(F.xxhash64(F.col(key))).alias("h"), F.when(F.col(key).isNull(), keyed_uniform(*named)).otherwise(keyed_uniform(F.col(key))).alias("u"))
    some = hashed.where(F.col("u") < F.element_at(rate, F.col("label"))).groupBy("label", "h").agg(F.min("text").alias("text"))
    first = Window.partitionBy("label").orderBy("h", "text")
    picked = some.withColumn("n", F.row_number().over(first)).where(F.col("n") <= per_language).withColumn("rows", F.count(F.lit(1)).over(Window.partitionBy("label")))
    # A share of each text, by the rows that there are: pieces of about PIECE characters, spread from its begin to its end.
    share = F.greatest(F.lit(64), F.floor(F.lit(size) / F.col("rows")).cast("int"))
    pieces = F.greatest(F.lit(1), F.floor(share / PIECE).cast("int"))
    width = F.floor(share / pieces).cast("int")
    length = F.length("text").cast("long")
    begin = lambda i: (F.lit(1) + F.floor((length - width) * i / F.greatest(F.lit(1), pieces - 1))).cast("int")
    spread = F.array_join(F.transform(F.sequence(F.lit(0), pieces - 1), lambda i: F.substring(F.col("text"), begin(i), width)), " ")
    sample = picked.select("label", "n", F.when(length <= share, F.col("text")).otherwise(spread).alias("piece")).orderBy("label", "n").collect()
    out: dict[str, bytes] = {}
    for r in sample:
        out[r["label"]] = out.get(r["label"], b"") + normal(r["piece"]) + b" "
    return {k: v[-size:] for k, v in sorted(out.items())}


#: ASCII other than letters becomes a space.
_SPACED = bytes(b if chr(b).isalpha() or b > 127 else 32 for b in range(256))


def normal(text: str) -> bytes:
    """What is compressed: words in lower case, one space between; case, digits and punctuation say little about a language."""
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_SPACED).split())


class Coder:
    """Compresses with one language's dictionary."""

    def __init__(self, raw: bytes) -> None:
        import zstandard

        def made(level: int) -> zstandard.ZstdCompressor:
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            return zstandard.ZstdCompressor(level=level, dict_data=d, write_checksum=False, write_content_size=False)

        self.blocks, self.short = made(LEVEL), made(SHORT_LEVEL)
        self.tail = raw[-TAIL:]
        self.tail_bytes = len(self.short.compress(self.tail))

    def size(self, cuts: list[bytes]) -> int:
        if len(cuts) == 1:
            return max(1, len(self.short.compress(self.tail + cuts[0] + b" ")) - self.tail_bytes)
        return sum(map(len, map(self.blocks.compress, cuts)))


def compressors(contents: list[bytes]) -> list[Coder]:
    return [Coder(raw) for raw in contents]


def cuts_of(text: str, block: int = BLOCK) -> list[bytes]:
    raw = normal(text)
    n = len(raw)
    parts = max(1, -(-n // block))
    return [raw[n * i // parts : n * (i + 1) // parts] for i in range(parts)]


def sizes(text: str, by: list[Coder], block: int = BLOCK) -> list[int]:
    """Bytes of all blocks of a text together, for each compressor."""
    cuts = cuts_of(text, block)
    return [c.size(cuts) for c in by]


def kept(text: str | None, by: list[Coder], margin: float = MARGIN) -> bool:
    """Whether the pipeline keeps a text: the best language is ahead by the margin, or one block tells nothing."""
    if not text or not any(map(str.isalpha, text)):
        return False
    if not by:
        return True
    cuts = cuts_of(text)
    got = sorted(c.size(cuts) for c in by)
    return len(got) < 2 or got[1] / got[0] - 1 >= margin or (len(cuts) == 1 and got[0] == got[1])


def identify(docs: DataFrame, dictionaries: dict[str, bytes], key: str = "doc_id", text: str = "text", margin: float = MARGIN) -> DataFrame:
    """key, lang_pred, score, rejected, the compressed bytes (of one block: those that it adds) of the best and the second. score = min(1, (second / best - 1) / 0.2)."""
    names = sorted(dictionaries)
    sent = docs.sparkSession.sparkContext.broadcast([dictionaries[k] for k in names])
    kind = docs.schema[key].dataType.simpleString()

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = compressors(sent.value)
        for part in gathered(batches, text):
            lang, score, rejected, best, second = [], [], [], [], []
            for t in part.column(text).to_pylist():
                if not made or not t or not any(map(str.isalpha, t)):
                    lang.append(UNKNOWN)
                    score.append(0.0)
                    rejected.append(True)
                    best.append(0)
                    second.append(0)
                    continue
                got = sizes(t, made)
                i = min(range(len(got)), key=got.__getitem__)
                other = min((x for j, x in enumerate(got) if j != i), default=2 * got[i])
                gap = other / got[i] - 1
                lang.append(names[i])
                score.append(min(1.0, gap / 0.2))
                rejected.append(gap < margin)
                best.append(got[i])
                second.append(other)
            yield pa.RecordBatch.from_arrays([part.column(key), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_()), pa.array(best, pa.int64()), pa.array(second, pa.int64())], ["key", "lang_pred", "score", "rejected", "best_bytes", "second_bytes"])

    return docs.select(key, text).mapInArrow(predict, f"key {kind}, lang_pred string, score double, rejected boolean, best_bytes long, second_bytes long").withColumnRenamed("key", key)


def drop_rejected(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", margin: float = MARGIN) -> DataFrame:
    """The rows whose language is not rejected, and those of one block that tell nothing, with the columns they came with."""
    sent = docs.sparkSession.sparkContext.broadcast([dictionaries[k] for k in sorted(dictionaries)])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = compressors(sent.value)
        for part in gathered(batches, text):
            yield part.filter(pa.array([kept(t, made, margin) for t in part.column(text).to_pylist()], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(crc_mod("doc_id", 3) != 1)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = identify(docs, learn(training_rows(docs)))
    return found.withColumn("held_out", crc_mod("doc_id", 3) == 1)
