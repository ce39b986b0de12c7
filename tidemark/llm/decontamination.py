"""Benchmark decontamination with an FM-index of each training shard.

The phrases to find are windows of ten consecutive benchmark words (all words of a shorter item). A shard
is a slice of a partition of documents: its words become numbers of the phrases' vocabulary, words beside
which no phrase has the neighbour that they have become unsearchable stops, and a suffix array of the
rest gives the Burrows-Wheeler transform, held in a wavelet matrix with running ranks. Phrases are
searched backwards, all at once; occurrences are located by walking to sampled suffix positions; and the
spans found are merged. Every document is indexed whole, no row moves, and nothing is shuffled.

Benchmark phrases are sent to the executors in blocks of at most BLOCK_WINDOWS words. A slice of documents is searched
for all blocks before the next slice is read: spans of all blocks are merged text by text, so the number of blocks
changes no result, and a benchmark of any size works; driver and workers hold one block at a time.

Defined results: words are runs of ASCII letters and digits and of anything beyond ASCII, A-Z lower-cased;
NULL and empty texts have no words and no hits; a very long text is a slice of its own, searched whole; items without words match nothing; items that repeat an
id count once; repeated rows get equal results; other columns pass only where the caller keeps the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import gathered, read

WINDOW = 10
SHARD = 4_000_000
SAMPLE = 16
BLOCK_WINDOWS = 400_000

_WORDS = bytes((b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32) for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


class Phrases:
    """Windows of benchmark items, as numbers of a vocabulary; which items have which window."""

    def __init__(self, items: list[tuple], window: int = WINDOW) -> None:
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary
        seen: dict[tuple[int, ...], int] = {}
        pairs, singles = set(), set()
        owners: list[tuple[int, int]] = []
        self.items = [str(k) for k, _ in items]
        for at, (_, text) in enumerate(items):
            ids = [number.setdefault(w, len(number) + 1) for w in words_of(text)]
            if not ids:
                continue
            if len(ids) == 1:
                singles.add(ids[0])
            pairs.update(zip(ids, ids[1:], strict=False))
            for i in range(max(1, len(ids) - window + 1)):
                owners.append((seen.setdefault(tuple(ids[i : i + window]), len(seen)), at))
        self.windows = len(seen)
        self.lengths = np.fromiter(map(len, seen), np.int64, len(seen))
        self.words = np.zeros((len(seen), window), np.int64)
        for w, i in seen.items():
            self.words[i, window - len(w) :] = w
        owned = np.array(sorted(set(owners)), np.int64).reshape(-1, 2)
        self.owner_at = np.searchsorted(owned[:, 0], np.arange(len(seen) + 1))
        self.owner = owned[:, 1]
        size = len(number) + 1
        self.size = size
        self.pairs = np.array(sorted(a * size + b for a, b in pairs), np.int64)
        self.single = np.zeros(size, bool)
        self.single[list(singles)] = True


def suffix_array(s: np.ndarray) -> np.ndarray:
    """By prefix doubling over the suffixes that are still tied. Values must end apart: each stop is a value of its own."""
    n = len(s)
    order = np.argsort(s, kind="stable")
    new = np.empty(n, bool)
    new[:1] = True
    new[1:] = s[order][1:] != s[order][:-1]
    rank = np.empty(n, np.int64)
    first = np.flatnonzero(new)
    rank[order] = np.repeat(first, np.diff(np.append(first, n)))
    step = 1
    while True:
        # Places in `order` that share their rank with a neighbour.
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            return order
        who = order[at]
        nxt = who + step
        second = np.where(nxt < n, rank[np.minimum(nxt, n - 1)], -1)
        sub = np.lexsort((second, rank[who]))
        who, second = who[sub], second[sub]
        order[at] = who
        head = rank[who]
        cut = np.empty(len(at), bool)
        cut[0] = True
        cut[1:] = (head[1:] != head[:-1]) | (second[1:] != second[:-1])
        new[at] = cut
        begin = np.flatnonzero(cut)
        rank[who] = np.repeat(at[begin], np.diff(np.append(begin, len(at))))
        step *= 2


class WaveletMatrix:
    """rank(c, i): how often c stands before place i."""

    def __init__(self, s: np.ndarray, size: int) -> None:
        self.bits = max(1, int(size - 1).bit_length())
        self.zeros, self.ones = [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (s >> level) & 1
            ones = np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32)
            self.ones.append(ones)
            self.zeros.append(len(s) - int(ones[-1]))
            up = bit.astype(bool)
            s = np.concatenate([s[~up], s[up]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        low = np.zeros_like(i)
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            up = ((c >> (self.bits - 1 - k)) & 1).astype(bool)
            a, b = ones[low].astype(np.int64), ones[i].astype(np.int64)
            low = np.where(up, zeros + a, low - a)
            i = np.where(up, zeros + b, i - b)
        return i - low


class FMIndex:
    """Of a sequence of numbers below `size`; 0 is a stop, and no pattern has it."""

    def __init__(self, s: np.ndarray, size: int) -> None:
        n = len(s)
        stop = s == 0
        distinct = np.where(stop, np.cumsum(stop), s + int(stop.sum()))
        order = suffix_array(distinct)
        self.last = s[order - 1]  # of place 0: the last stop
        self.tree = WaveletMatrix(self.last, size)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=size))])
        # Stops are ordered by place, not by what follows them, so no step may lead over one.
        sampled = (order % SAMPLE == 0) | (self.last == 0)
        self.sampled = sampled
        self.sample_at = np.cumsum(sampled) - 1
        self.samples = order[sampled]
        self.n = n

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of suffixes that begin with each right-aligned pattern (0: no word)."""
        low, high = np.zeros(len(words), np.int64), np.full(len(words), self.n, np.int64)
        live = np.arange(len(words))
        for k in range(words.shape[1] - 1, -1, -1):
            live = live[(low[live] < high[live]) & (words[live, k] > 0)]
            if not len(live):
                break
            c = words[live, k]
            low[live] = self.before[c] + self.tree.rank(c, low[live])
            high[live] = self.before[c] + self.tree.rank(c, high[live])
        return low, high

    def locate(self, places: np.ndarray) -> np.ndarray:
        """Positions of suffixes, by steps back to a sampled one."""
        out = np.empty(len(places), np.int64)
        steps = np.zeros(len(places), np.int64)
        todo, at = np.arange(len(places)), places.copy()
        while len(todo):
            hit = self.sampled[at]
            out[todo[hit]] = self.samples[self.sample_at[at[hit]]] + steps[todo[hit]]
            todo, at = todo[~hit], at[~hit]
            c = self.last[at]
            at = self.before[c] + self.tree.rank(c, at)
            steps[todo] += 1
        return out


def scan(texts: list, phrases: Phrases) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """For each text: number of words, merged word spans (rows of begin, end), numbers of the items found."""
    known = phrases.vocabulary.get
    counts = np.zeros(len(texts), np.int64)
    parts = []
    for i, t in enumerate(texts):
        words = words_of(t)
        counts[i] = len(words)
        parts.append(np.array([known(w, 0) for w in words], np.int64))
        parts.append(np.zeros(1, np.int64))
    nothing = np.empty((0, 2), np.int64), np.empty(0, np.int64)
    spans, found = [nothing[0]] * len(texts), [nothing[1]] * len(texts)
    if not phrases.windows or not counts.sum():
        return counts, spans, found
    s = np.concatenate(parts)
    begins = np.concatenate([[0], np.cumsum(counts + 1)])
    pair = s[:-1] * phrases.size + s[1:]
    at = np.searchsorted(phrases.pairs, pair)
    linked = np.zeros(len(pair), bool)
    if len(phrases.pairs):
        linked = (phrases.pairs[np.minimum(at, len(phrases.pairs) - 1)] == pair) & (s[:-1] > 0) & (s[1:] > 0)
    live = phrases.single[s]
    live[:-1] |= linked
    live[1:] |= linked
    # Runs of dead words become one stop; `where` leads back.
    keep = live.copy()
    keep[1:] |= live[:-1]
    keep[-1] = True
    where = np.flatnonzero(keep)
    reduced = np.where(live[where], s[where], 0)
    if len(reduced) == 1:
        return counts, spans, found
    index = FMIndex(reduced, phrases.size)
    low, high = index.find(phrases.words)
    times = np.maximum(high - low, 0)
    which = np.repeat(np.arange(len(times)), times)
    if not len(which):
        return counts, spans, found
    inside = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
    start = where[index.locate(low[which] + inside)]
    length = phrases.lengths[which]
    doc = np.searchsorted(begins, start, "right") - 1
    change = np.zeros(len(s) + 1, np.int32)
    np.add.at(change, start, 1)
    np.add.at(change, start + length, -1)
    covered = np.cumsum(change[:-1]) > 0
    edge = np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))
    first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # No occurrence passes a stop, so no span passes a text's end.
    of = np.searchsorted(begins, first, "right") - 1
    seen = np.unique(doc * np.int64(phrases.windows) + which)
    doc, which = seen // phrases.windows, seen % phrases.windows
    n_owners = phrases.owner_at[which + 1] - phrases.owner_at[which]
    k = np.arange(int(n_owners.sum())) - np.repeat(np.cumsum(n_owners) - n_owners, n_owners)
    items = np.unique(np.repeat(doc, n_owners) * np.int64(len(phrases.items)) + phrases.owner[np.repeat(phrases.owner_at[which], n_owners) + k])
    for i in np.unique(of):
        a, b = np.searchsorted(of, [i, i + 1])
        spans[i] = np.stack([first[a:b], end[a:b]], 1) - begins[i]
    doc, items = items // len(phrases.items), items % len(phrases.items)
    for i in np.unique(doc):
        a, b = np.searchsorted(doc, [i, i + 1])
        found[i] = items[a:b]
    return counts, spans, found


def blocks(benchmark: DataFrame, key: str, text: str, most: int = BLOCK_WINDOWS) -> Iterator[list[tuple]]:
    """Items in blocks of a bounded number of words, read one partition at a time."""
    held, size = [], 0
    for r in benchmark.select(key, text).toLocalIterator():
        n = len(words_of(r[1]))
        if held and size + n > most:
            yield held
            held, size = [], 0
        held.append((r[0], r[1]))
        size += n
    yield held


def sent_blocks(docs: DataFrame, benchmark: DataFrame, item: str, item_text: str) -> list:
    """A broadcast of each block. The driver holds one block at a time: what it sent lies in files."""
    return [docs.sparkSession.sparkContext.broadcast(Phrases(items)) for items in blocks(benchmark, item, item_text)]


def scan_all(texts: list, sent: list) -> tuple[np.ndarray, list[np.ndarray], list[set[str]]]:
    """As scan(), of all blocks: words, merged spans, ids of the items found. A worker holds one block at a time."""
    counts, spans, found = np.zeros(len(texts), np.int64), [np.empty((0, 2), np.int64)] * len(texts), [set() for _ in texts]
    for one in sent:
        phrases = one.value
        counts, more, items = scan(texts, phrases)
        for i, x in enumerate(more):
            if len(x):
                spans[i] = merged_spans([spans[i], x]) if len(spans[i]) else x
                found[i] |= {phrases.items[j] for j in items[i].tolist()}
        if len(sent) > 1 and getattr(one, "_path", None):
            vars(one).pop("_value", None)  # it is read again from its file
    return counts, spans, found


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """key, n_words, spans (word begin and end, merged), items (ids of items with an occurring window, sorted) of each row."""
    kind = docs.schema[key].dataType.simpleString()
    out_type = pa.list_(pa.struct([("b", pa.int64()), ("e", pa.int64())]))
    sent = sent_blocks(docs, benchmark, item, item_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in gathered(batches, text, SHARD):
            n, spans, found = scan_all(part.column(text).to_pylist(), sent)
            yield pa.RecordBatch.from_arrays([part.column(key), pa.array(n), pa.array([[{"b": b, "e": e} for b, e in x.tolist()] for x in spans], out_type), pa.array(list(map(sorted, found)), pa.list_(pa.string()))], ["key", "n_words", "spans", "items"])

    return docs.select(key, text).mapInArrow(run, f"key {kind}, n_words long, spans array<struct<b:long,e:long>>, items array<string>").withColumnRenamed("key", key)


def remove_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows, with the words of every span cut out of the text, from the first word's begin to the last word's end.

    What stood around a span stays. Rows without a span are returned as they are. The spans of all blocks of phrases
    are found on the same text, merged and cut once; what a cut brings together is looked for again in all blocks.
    """
    sent = sent_blocks(docs, benchmark, item, item_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in gathered(batches, text, SHARD):
            clean = part.column(text).to_pylist()
            changed = False
            at = list(range(len(clean)))
            while at:  # what a cut brings together may be a phrase again
                spans = scan_all([clean[i] for i in at], sent)[1]
                at, spans = [i for i, x in zip(at, spans, strict=True) if len(x)], [x for x in spans if len(x)]
                for i, x in zip(at, spans, strict=True):
                    clean[i] = cut_words(clean[i], x)
                    changed = True
            if changed:
                part = part.set_column(part.schema.get_field_index(text), part.schema.field(text), pa.array(clean, part.schema.field(text).type))
            yield part

    return docs.mapInArrow(run, docs.schema)


def merged_spans(parts: list[np.ndarray]) -> np.ndarray:
    """Spans of several blocks as one block gives them: those that overlap or touch are one."""
    out: list[list[int]] = []
    for b, e in sorted(x for part in parts for x in part.tolist()):
        if out and b <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([b, e])
    return np.array(out, np.int64).reshape(-1, 2)


def cut_words(text: str, spans: np.ndarray) -> str:
    raw = text.encode("utf-8", "surrogatepass")
    mask = np.frombuffer(raw.translate(_WORDS), np.uint8) != 32
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out, at = [], 0
    for b, e in spans.tolist():
        out.append(raw[at : begin[b]])
        at = int(end[e - 1])
    out.append(raw[at:])
    return b"".join(out).decode("utf-8", "surrogatepass")


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["e"] - x["b"])
    return found.select(key, "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.encode(F.concat_ws(",", "items"), "UTF-8"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")))
