"""N-gram Jaccard self-join by a MinHash LSH forest, with exact verification.

Each text has a MinHash signature of TREES labels of LONGEST hashes (one-permutation hashing: a shingle falls
into one bin; an empty bin takes over the filled bin of least shared random rank). The labels of all texts
are sorted, tree by tree: a sorted run of labels that share a prefix is a node of that tree's prefix trie, and
what neighbours in the order have in common is the depth of their lowest common node. Then:

1. Equal word sequences become one class (copies are counted, not paired).
2. Every text shortens its prefix from LONGEST until its recall reaches TARGET by what it met. A first pass over the sorted labels
   tells the depth of each label's company, so the number of trees in which a text has company at each depth is known. A text of the
   threshold's similarity that was not met at depth k would leave company in a binomial number of trees at the depths above k; a text
   with so little company that such a neighbour is too unlikely keeps its prefix, all others shorten it, at most
   to the depth at which the chance alone gives TARGET for the least similarity that reaches the threshold and that a set of its size can
   have at all (a set of three shingles has none below 1, so it stays at LONGEST). The run of the prefix is matched with the text in each tree.
   Runs are found in a second pass, over the labels that have company, from neighbours alone, and are linked to
   their least text; ranges may cut a run anywhere, so a run may hold any share of the rows.
3. Linked texts are components of candidates, which are verified exactly, all pairs of shingle sets inside them, in
   blocks of a bounded number of shingles: a large component is the set of its block pairs, each a group of its own,
   dealt in turn. A block pair gives out a number of links and one link to a root for each class, never its pairs.
4. Verified links make the final classes.

Defined results: shingles are five words, lower-cased; texts of one to four words have one shingle; NULL, empty
and wordless texts are alone with no links; repeated rows are copies; class_id is the least key of a class,
NULL only if all its keys are NULL; a very long text is a slice and a block of its own. Other columns are neither
read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_stored, gathered, read, scratch, slices, stored
from .shingles import Shingled, mix

THRESHOLD = 0.8
TREES, LONGEST, TARGET = 32, 8, 0.999
BINS = TREES * LONGEST
#: Shingles, and classes, that a block of a component holds, about.
BLOCK, BLOCK_ROWS = 100_000, 256
#: Bits of a label's hash at one level. Four levels fill a word of a label; the tree's number leads the first, the text's depth ends the second.
LEVEL, HALF, DEPTH_BITS = 14, 4, 4
#: A class of more than this part of all rows is hot.
HOT = 1000
#: Sets of up to so many shingles have a depth of their own.
SMALL = 64
#: Company is counted from this level on; what meets above it (28 bits) may meet by chance in a large table.
EVIDENCE = 3

_rng = np.random.Generator(np.random.PCG64(77))
_ORDER = _rng.integers(1 << 30, size=(BINS, BINS), dtype=np.int32)
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def prefix_length(threshold: float = THRESHOLD, target: float = TARGET, trees: int = TREES, longest: int = LONGEST) -> int:
    """The longest prefix at which texts of the threshold's similarity meet in a tree with the target probability."""
    k = longest
    while k > 1 and 1 - (1 - threshold**k) ** trees < target:
        k -= 1
    return k


def least_similarity(n: int, threshold: float) -> float:
    """The least Jaccard similarity of at least the threshold that a set of n can have with any other."""
    found = 1.0
    for missing in range(int(n * (1 - threshold) + 1e-9) + 1):
        more = int((n - missing) / threshold - n + 1e-9)
        found = min(found, (n - missing) / (n + more))
    return found


def depths(threshold: float, target: float) -> np.ndarray:
    """Prefix lengths by number of shingles; the last is that of all larger sets."""
    return np.array([LONGEST] + [prefix_length(least_similarity(n, threshold), target) for n in range(1, SMALL + 1)] + [prefix_length(threshold, target)], np.int64)


def enough_company(threshold: float, target: float) -> dict[int, dict[int, dict[int, int]]]:
    """By least depth of a text, by depth k, by level j: the most trees with company at level j for which the text need not shorten below k.

    A neighbour of similarity s that meets the text at depth k in no tree shares level j < k in a binomial number of trees with
    chance (s^j - s^k) / (1 - s^k) each. What the least depth leaves of 1 - target is spent in equal parts on all (k, j)."""
    sims = [least_similarity(n, threshold) for n in range(1, SMALL + 1)] + [threshold]
    by_size = depths(threshold, target)[1:].tolist()
    out: dict[int, dict[int, dict[int, int]]] = {}
    for least in sorted(set(by_size) - {LONGEST}):
        s = min(x for x, d in zip(sims, by_size, strict=True) if d == least)
        tests = [(k, j) for k in range(least + 1, LONGEST + 1) for j in range(EVIDENCE, k)]
        part = max(0.0, 1 - target - (1 - s**least) ** TREES) / max(1, len(tests))
        for k, j in tests:
            q, below, c = (s**j - s**k) / (1 - s**k), 0.0, 0
            while c <= TREES and (1 - s**k) ** TREES * (below + comb(TREES, c) * q**c * (1 - q) ** (TREES - c)) <= part:
                below += comb(TREES, c) * q**c * (1 - q) ** (TREES - c)
                c += 1
            if c:
                out.setdefault(least, {}).setdefault(k, {})[j] = c - 1
    return out


def chosen_depth(least: Column, company: dict[int, Column], threshold: float, target: float) -> Column:
    """The depth of a text by its least depth and its trees with company at each level."""
    told = F.lit(None).cast("int")
    for d, by_depth in enough_company(threshold, target).items():
        for k, most in sorted(by_depth.items()):  # the longest prefix is asked first
            few = F.lit(False)
            for j, c in most.items():
                few |= company[j] <= c
            told = F.when((least == d) & few, F.lit(k)).otherwise(told)
    return F.coalesce(told, least.cast("int"))


def signatures(s: Shingled) -> np.ndarray:
    """Hashes of each text, (texts, BINS); texts without shingles have NONE."""
    n = len(s.words)
    flat = np.full(n * BINS, NONE)
    np.minimum.at(flat, s.doc * BINS + ((s.hash >> np.uint64(32)) % np.uint64(BINS)).astype(np.int64), s.hash)
    out = flat.reshape(n, BINS)
    empty = out == NONE
    for i in np.flatnonzero(empty.any(1) & (s.words > 0)):
        holes, full = np.flatnonzero(empty[i]), np.flatnonzero(~empty[i])
        out[i, holes] = out[i, full[_ORDER[holes][:, full].argmin(1)]]
    return out


def labels_of(sig: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Two words for each text and tree, (texts, TREES, 2), whose order is that of (tree, label)."""
    level = (mix(sig) >> np.uint64(64 - LEVEL)).astype(np.int64).reshape(len(sig), TREES, 2, HALF)
    shift = LEVEL * np.arange(HALF - 1, -1, -1)
    words = (level << shift).sum(3)
    words[:, :, 0] |= np.arange(TREES) << (LEVEL * HALF)
    words[:, :, 1] = words[:, :, 1] << DEPTH_BITS | depth[:, None]
    return words


def common_levels(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many levels the labels (rows of two words) have in common; none if they are of different trees."""
    first, second = a[:, 0] ^ b[:, 0], a[:, 1] >> DEPTH_BITS ^ b[:, 1] >> DEPTH_BITS
    out = np.zeros(len(a), np.int64)
    for k in range(1, HALF + 1):
        rest = LEVEL * (HALF - k)
        out += (first >> rest == 0).astype(np.int64) + ((first == 0) & (second >> rest == 0))
    return out


def prefix_key(label: np.ndarray, levels: int) -> np.ndarray:
    """A 64-bit name of each label's prefix."""
    first = label[:, 0] >> (LEVEL * max(0, HALF - levels))
    second = label[:, 1] >> (DEPTH_BITS + LEVEL * (LONGEST - max(levels, HALF)))
    return mix(mix(first.astype(np.uint64)) + second.astype(np.uint64)).astype(np.int64)


def matched(label: np.ndarray, ends_open: tuple[bool, bool] = (True, True)) -> np.ndarray:
    """Of labels in order: whether each belongs to one matched run with the next. A run is matched if its
    prefix is the whole shortened prefix of some text in it; runs that reach an open end may have such a text beyond."""
    near = common_levels(label[:-1], label[1:])
    depth = label[:, 1] & ((1 << DEPTH_BITS) - 1)
    out = np.zeros(len(near), bool)
    for d in range(int(depth.min(initial=LONGEST)), LONGEST + 1):
        same = near >= d
        run = np.concatenate([[0], np.cumsum(~same)])
        wanted = np.zeros(int(run[-1]) + 1, bool)
        wanted[run[depth == d]] = True
        wanted[0] |= ends_open[0]
        wanted[-1] |= ends_open[1]
        out |= same & wanted[run[:-1]]
    return out


def described(docs: DataFrame, key: str, text: str, threshold: float, target: float) -> DataFrame:
    """key, text hash, sequence hashes h1 and h2, words, labels of each row."""
    kind = docs.schema[key].dataType.simpleString()
    by_size = depths(threshold, target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in gathered(batches, "text"):
            s = Shingled(part.column("text").to_pylist())
            cuts = np.searchsorted(s.doc, np.arange(len(s.words) + 1))
            count = np.minimum(np.diff(cuts), SMALL + 1)
            for i in np.flatnonzero((count > 0) & (count <= SMALL)):
                count[i] = len(np.unique(s.hash[cuts[i] : cuts[i + 1]]))
            labels = labels_of(signatures(s), by_size[count])
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("th"), pa.array(s.sequence[0]), pa.array(s.sequence[1]), pa.array(s.words.astype(np.int64)), pa.array([x.tobytes() for x in labels], pa.binary())], ["key", "th", "h1", "h2", "words", "labels"])

    rows = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, th long, h1 long, h2 long, words long, labels binary")


def company(classes: DataFrame, floor: int) -> DataFrame:
    """l1, l2, h1, met of the labels that share at least floor levels with another: met is the most levels shared, which a neighbour in the order has.

    The outermost labels of a range, whose neighbour lies in another one, count as meeting at LONGEST: that can only shorten a prefix."""

    def planted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                words = np.frombuffer(b"".join(b.column("labels").to_pylist()), np.int64).reshape(-1, 2)
                nodes = np.repeat(b.column("h1").to_numpy(), TREES)
                yield pa.RecordBatch.from_arrays([pa.array(words[:, 0]), pa.array(words[:, 1]), pa.array(nodes)], ["l1", "l2", "h1"])

    def met_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label, node = np.empty((0, 2), np.int64), np.empty(0, np.int64)
        before = LONGEST  # levels that the first label held has in common with the one before it

        def told(met: np.ndarray) -> pa.RecordBatch:
            some = np.flatnonzero(met >= floor)
            return pa.RecordBatch.from_arrays([pa.array(label[some, 0]), pa.array(label[some, 1]), pa.array(node[some]), pa.array(met[some].astype(np.int32))], ["l1", "l2", "h1", "met"])

        for b in batches:
            if not b.num_rows:
                continue
            label = np.concatenate([label, np.stack([b.column("l1").to_numpy(), b.column("l2").to_numpy()], 1)])
            node = np.concatenate([node, b.column("h1").to_numpy()])
            near = np.concatenate([[before], common_levels(label[:-1], label[1:])])
            # The last label waits for its neighbour.
            yield told(np.maximum(near[:-1], near[1:]))
            label, node, before = label[-1:], node[-1:], int(near[-1])
        if len(node):
            yield told(np.array([LONGEST]))

    order = ["l1", "l2", "h1"]
    leaves = classes.select("labels", "h1").mapInArrow(planted, "l1 long, l2 long, h1 long")
    return leaves.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(met_in, "l1 long, l2 long, h1 long, met int")


def with_depths(met: DataFrame, threshold: float, target: float) -> DataFrame:
    """h1, depth of each text that has a label with company."""
    least = F.min(F.col("l2").bitwiseAND((1 << DEPTH_BITS) - 1)).alias("least")
    counts = met.groupBy("h1").agg(least, *[F.count_if(F.col("met") >= j).alias(f"c{j}") for j in range(EVIDENCE, LONGEST)])
    return counts.select("h1", chosen_depth(F.col("least"), {j: F.col(f"c{j}") for j in range(EVIDENCE, LONGEST)}, threshold, target).alias("depth"))


def forest_links(classes: DataFrame, threshold: float, target: float) -> DataFrame:
    """a, b (h1 of two texts): what connects the texts of every matched run.

    Labels that have company are dealt into sorted ranges, each with its text's depth; each range is walked once. Runs that a range's border cuts are put
    together by the name of their prefix of the least depth of any text, from the two outermost labels of each range."""
    floor = int(depths(threshold, target).min())

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label, node = np.empty((0, 2), np.int64), np.empty(0, np.int64)
        border: list[tuple[int, int]] = []
        for b in batches:
            if not b.num_rows:
                continue
            # The last text of the batch before stands for its run so far.
            label = np.concatenate([label[-1:], np.stack([b.column("l1").to_numpy(), b.column("l2").to_numpy()], 1)])
            node = np.concatenate([node[-1:], b.column("h1").to_numpy()])
            joined = matched(label)
            at = np.flatnonzero(np.concatenate([[True], ~joined]))
            least = np.minimum.reduceat(node, at)
            lead = np.repeat(least, np.diff(np.append(at, len(node))))
            if not border:
                border.append((int(lead[0]), int(prefix_key(label[:1], floor)[0])))
            apart = node != lead
            pairs = np.unique(np.stack([node[apart], lead[apart]], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(np.ones(len(pairs), bool))], ["a", "b", "link"])
            node[-1] = lead[-1]
        if border:
            border.append((int(node[-1]), int(prefix_key(label[-1:], floor)[0])))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in border]), pa.array([x[1] for x in border]), pa.array([False] * 2)], ["a", "b", "link"])

    order = ["l1", "l2", "h1"]
    met = stored(company(classes, min(floor, EVIDENCE)), "company")
    bits = F.lit((1 << DEPTH_BITS) - 1).cast("long")
    deep = met.where(F.col("met") >= floor).join(with_depths(met, threshold, target), "h1")
    leaves = deep.select("l1", F.col("l2").bitwiseAND(F.bitwise_not(bits)).bitwiseOR(F.col("depth").cast("long")).alias("l2"), "h1")
    found = stored(leaves.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(walked, "a long, b long, link boolean"), "forest")
    border = found.where("NOT link").select("a", F.col("b").alias("prefix"))
    across = border.join(border.groupBy("prefix").agg(F.min("a").alias("b")), "prefix").where("a <> b").select("a", "b")
    return found.where("link").select("a", "b").unionByName(across)


def components(edges: DataFrame) -> DataFrame:
    """node, label of an undirected graph (a, b): the least node of each connected component.

    Each node hands its other smaller neighbours over to its least one, until every node has one smaller neighbour; then
    these are followed, twice as far each time. Tables of each round are written, so no plan grows.
    """
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    starred = None
    while True:
        before, starred = starred, stored(pairs.withColumn("m", F.min("b").over(Window.partitionBy("a"))), "stars")
        if before is not None:
            drop_stored(before)
        if not starred.where("b <> m").take(1):
            break
        pairs = starred.select(F.explode(F.when(F.col("b") == F.col("m"), F.array(F.struct("a", F.col("m").alias("b")))).otherwise(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))).alias("e")).select("e.a", "e.b").distinct()
    up = starred.select("a", "b")
    while True:
        further = up.select(F.col("a").alias("b"), F.col("b").alias("c"))
        jumped = stored(up.join(further, "b", "left").select("a", F.coalesce("c", "b").alias("b"), F.col("c").isNotNull().alias("moved")), "jumps")
        drop_stored(up)
        up = jumped.select("a", "b")
        if not jumped.where("moved").take(1):
            return up.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(up.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def verify(sets: list[np.ndarray], side: np.ndarray, weight: np.ndarray, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For each set: weight of its links, number of the least set it is connected with. Links within all sets (same) or across the two sides."""
    n = len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, n)
    root = np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    links = np.zeros(n, np.int64)
    if n < 2 or not sizes.sum():
        return links, root
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(values, kind="stable")
    by, who = values[order], owner[order]
    new = np.concatenate([[True], by[1:] != by[:-1]])
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(by)))
    ids = np.empty(len(by), np.int64)
    ids[order] = np.cumsum(new) - 1
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    for i in range(n):
        if not same and side[i]:
            continue
        mine = ids[cuts[i] : cuts[i + 1]]
        mine = mine[count[mine] > 1]
        if not len(mine):
            continue
        k = count[mine]
        at = np.repeat(begin[mine] - np.concatenate([[0], np.cumsum(k)[:-1]]), k) + np.arange(int(k.sum()))
        common = np.bincount(who[at], minlength=n)
        common[i] = 0
        good = common * (1 + threshold) >= threshold * (sizes + sizes[i]) - 1e-9
        good &= common > 0
        if not same:
            good &= side
        else:
            good[:i] = False
        for j in np.flatnonzero(good).tolist():
            links[i] += weight[j]
            links[j] += weight[i]
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
    return links, np.array([find(i) for i in range(n)])


def linked(reps: DataFrame, docs: DataFrame, key: str, text: str, threshold: float) -> DataFrame:
    """h1, h2, links, root (an h1) for the classes of candidate components with a verified link in some block pair.

    reps: key, th, h1, h2, copies, label, blocks. The texts of one row of each class are fetched by an equi-join.
    """
    kind = docs.schema[key].dataType.simpleString()
    texts = docs.select(F.col(key).alias("key_"), F.xxhash64(text).alias("th_"), F.col(text).alias("text"))
    # Sorted at every size: the plan doesn't change with the number of candidates, and one row's repeats come together.
    rows = texts.join(reps.hint("merge"), F.col("key_").eqNullSafe(F.col("key")) & (F.col("th_") == F.col("th"))).select("text", "h1", "h2", "copies", "label", "blocks")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for part in gathered(batches, "text"):
            # One row of each class is enough; equal rows come one after the other.
            names = list(zip(part.column("h1").to_pylist(), part.column("h2").to_pylist(), strict=True))
            part = part.filter(pa.array([x != y for x, y in zip(names, [last, *names], strict=False)], pa.bool_()))
            last = names[-1]
            if not part.num_rows:
                continue
            found = [x.tobytes() for x in Shingled(part.column("text").to_pylist()).sets()]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("h1", "h2", "copies", "label", "blocks")], pa.array(found, pa.binary())], ["h1", "h2", "copies", "label", "blocks", "shingles"])

    held = rows.mapInArrow(sets, "h1 long, h2 long, copies long, label long, blocks int, shingles binary")
    own = F.pmod(F.col("h2"), F.col("blocks")).cast("int")
    spread = held.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = spread.select("label", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "h1", "h2", "copies", "shingles", "blocks")

    def check(rows_: list[tuple]) -> Iterator[tuple]:
        i, j = rows_[0][1], rows_[0][2]
        once = {}
        for r in rows_:
            once.setdefault((r[4], r[5]), r)
        mine = sorted(once.values(), key=lambda r: (r[4], r[5]))
        links, root = verify([np.frombuffer(r[7], np.uint64) for r in mine], np.array([r[3] == j for r in mine]), np.array([r[6] for r in mine], np.int64), i == j, threshold)
        for r, n, to in zip(mine, links.tolist(), root.tolist(), strict=True):
            if n:
                yield r[4], r[5], n, mine[to][4], r[8]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [[], [], [], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)], ["h1", "h2", "links", "root", "blocks"])

        for part in slices(batches, "shingles", 32_000_000):
            for row in zip(*[part.column(c).to_pylist() for c in ("label", "i", "j", "own", "h1", "h2", "copies", "shingles", "blocks")], strict=True):
                if group and group[0][:3] != row[:3]:
                    out += check(group)
                    group = []
                group.append(row)
            if len(out) > 5000:
                yield batch()
                out = []
        if group:
            out += check(group)
        yield batch()

    # The pairs of one component are dealt in turn, so that no task gets several large ones by chance.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    turn = F.pmod(F.xxhash64("label") + F.col("i") * F.col("blocks") + F.col("j"), F.lit(tasks)).cast("int")
    return paired.repartitionById(tasks, turn).sortWithinPartitions("label", "i", "j").mapInArrow(blocks, "h1 long, h2 long, links long, root long, blocks int")


def near_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, target: float = TARGET) -> DataFrame:
    """key, th (hash of the text), copy_id, class_id, n_links, n_copies, first (whether the row stands for its class) of each row.

    The result is written to the shared folder at once; all tables on the way to it are removed."""
    with scratch(docs.sparkSession):
        return stored(_classes(docs, key, text, threshold, target), "near-classes", keep=True)


def _classes(docs: DataFrame, key: str, text: str, threshold: float, target: float) -> DataFrame:
    rows = stored(described(docs, key, text, threshold, target), "signatures")
    worded = rows.where("words > 0")
    least = F.min(F.struct(F.col("key").isNull().alias("n"), F.col("key"), F.col("th")))
    classes = stored(worded.groupBy("h1", "h2", "labels").agg(least.alias("rep"), F.count(F.lit(1)).alias("copies"), F.max("words").alias("words")).select("h1", "h2", F.col("rep.key").alias("key"), F.col("rep.th").alias("th"), "copies", "words", "labels"), "classes")
    labels = components(forest_links(classes, threshold, target))
    members = stored(classes.drop("labels").join(labels, F.col("h1") == F.col("node")).drop("node"), "members")
    sizes = members.groupBy("label").agg(F.ceil(F.greatest(F.sum("words") / BLOCK, F.count(F.lit(1)) / BLOCK_ROWS)).cast("int").alias("blocks"))
    found = stored(linked(members.join(sizes, "label").select("key", "th", "h1", "h2", "copies", "label", "blocks"), docs, key, text, threshold), "links")
    # Where one block held a whole component, its roots are final; else roots of several blocks are joined.
    several = found.where("blocks > 1 AND h1 <> root").select(F.col("h1").alias("a"), F.col("root").alias("b"))
    if several.take(1):
        more = components(several).withColumnRenamed("label", "final")
        found = found.join(more, F.col("root") == F.col("node"), "left").select("h1", "h2", "links", F.coalesce("final", "root").alias("root"))
    # Of classes with one first hash (never seen, but possible) each keeps to its root.
    named = members.join(found.groupBy("h1", "h2").agg(F.sum("links").alias("links"), F.min("root").alias("root")), ["h1", "h2"])
    firsts = named.groupBy("root").agg(least.alias("f")).select("root", F.col("f.key").alias("class_id"), F.col("f.th").alias("class_th"))
    known = stored(named.join(firsts, "root").select("h1", "h2", "class_id", "class_th", "links"), "known")
    every = stored(classes.select("h1", "h2", F.col("key").alias("copy_id"), F.col("th").alias("copy_th"), "copies").join(known, ["h1", "h2"], "left"), "every")
    # Classes of more than a thousandth of all rows are fewer than a thousand: they are sent to their rows, which stay where they are.
    most = (every.agg(F.sum("copies")).first()[0] or 0) / HOT
    hot = F.broadcast(every.where(F.col("copies") > most))
    named_rows = worded.select("key", "th", "h1", "h2")
    w = named_rows.join(hot, ["h1", "h2"]).unionByName(named_rows.join(hot, ["h1", "h2"], "left_anti").join(every.where(F.col("copies") <= most), ["h1", "h2"]))
    some = F.col("class_th").isNotNull()
    w = w.withColumn("class_id", F.when(some, F.col("class_id")).otherwise(F.col("copy_id"))).withColumn("class_th", F.coalesce("class_th", "copy_th"))
    w = w.select("key", "th", "copy_id", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n_copies"), (F.col("key").eqNullSafe(F.col("class_id")) & (F.col("th") == F.col("class_th"))).alias("first"))
    alone = rows.where("words = 0").select("key", "th", F.col("key").alias("copy_id"), F.col("key").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"), F.lit(True).alias("first"))
    return w.unionByName(alone).withColumnRenamed("key", key)


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that stand for their classes, one of each, with the columns they came with. Wordless rows all stay."""
    told = near_classes(docs, key, text, threshold).select(F.col(key).alias("_class_key"), F.col("th").alias("_class_text"), "first", F.col("n_copies").alias("_class_copies"))
    gone = told.where(~F.col("first")).select("_class_key", "_class_text").distinct()
    same = lambda: F.col(key).eqNullSafe(F.col("_class_key")) & (F.xxhash64(text) == F.col("_class_text"))
    kept = docs.join(gone, same(), "left_anti")
    # Rows that repeat key and text of a class's first row: one of them stays.
    twice = told.where("first AND _class_copies > 1").groupBy("_class_key", "_class_text").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_class_key", "_class_text")
    if not twice.take(1):
        return kept
    # Row numbers are limited to 1 before the shuffle, so a row may be repeated any number of times.
    again = kept.join(twice, same(), "left_semi").withColumn("_class_row", F.row_number().over(Window.partitionBy(key, F.xxhash64(text)).orderBy(F.lit(1))))
    return kept.join(twice, same(), "left_anti").unionByName(again.where("_class_row = 1").drop("_class_row"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_classes(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "n_links", "copy_id", "n_copies")
