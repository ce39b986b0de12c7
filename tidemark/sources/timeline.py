"""Nested edit timelines: an XML reader that keeps sibling order, and recursive expansion to absolute intervals.

Nodes are an adjacency list: doc, id, parent, ord, tag, attrs, text. Times are exact rationals.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import rational as R
from tidemark.shared import stored

#: Levels of nesting that a document may have.
DEEPEST = 128
MOST_BYTES = 16 * 1024 * 1024
NODES = "doc string, id long, parent long, ord int, tag string, attrs map<string,string>, text string, ok boolean, reason string"


def nodes_of(doc: str, raw: bytes) -> Iterator[tuple]:
    """The nodes of a document in document order; one row with a reason if it is refused (too large, entities, not one project)."""
    refused = lambda why: (doc, None, None, None, None, None, None, False, why)
    if len(raw) > MOST_BYTES:
        yield refused("too large")
        return
    if b"<!ENTITY" in raw:
        yield refused("entities")
        return
    try:
        root = ET.fromstring(raw)
    except ET.ParseError:
        yield refused("not XML")
        return
    if len(root.findall(".//project")) != 1 and root.tag != "project":
        yield refused("not one project")
        return
    stack, n = [(root, None, 0)], 0
    while stack:
        node, parent, place = stack.pop()
        yield doc, n, parent, place, node.tag, dict(node.attrib), (node.text or "").strip() or None, True, None
        stack += [(child, n, i) for i, child in reversed(list(enumerate(node)))]
        n += 1


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """SRC1: nodes of every file under the path."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, raw in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                rows = list(nodes_of(doc, raw))
                cols = list(zip(*rows, strict=True))
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), pa.bool_(), pa.string()]
                maps = [None if m is None else list(m.items()) for m in cols[5]]
                yield pa.RecordBatch.from_arrays([pa.array(maps if i == 5 else c, t) for i, (c, t) in enumerate(zip(cols, kinds, strict=True))], ["doc", "id", "parent", "ord", "tag", "attrs", "text", "ok", "reason"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, NODES)


def closure(nodes: DataFrame, depth: int = DEEPEST) -> DataFrame:
    """FIL5, FIL6: doc, ancestor, id, depth of every pair in a subtree, the node itself at depth 0. nodes: doc, id, parent.

    Level by level: each level is written before the next, so a plan holds one join, and rows and levels have no limit but depth."""
    children = stored(nodes.select("doc", F.col("id").alias("child"), "parent"), "children")
    level = stored(nodes.select("doc", F.col("id").alias("ancestor"), "id", F.lit(0).alias("depth")), "closure")
    every = level
    for k in range(1, depth + 1):
        below = level.join(children.withColumnRenamed("parent", "id"), ["doc", "id"]).select("doc", "ancestor", F.col("child").alias("id"), F.lit(k).alias("depth"))
        level = stored(below, "closure")
        if level.isEmpty():
            break
        every = every.unionByName(level)
    return every


def subtree_exists(nodes: DataFrame, wanted: DataFrame, depth: int = DEEPEST) -> DataFrame:
    """FIL5, FIL6: nodes that have one of `wanted` (doc, id) in their subtree: by walking up from these, so work follows the hits.

    Each level keeps every node once, and those seen before are not walked again."""
    up = stored(nodes.select("doc", "id", "parent"), "parents")
    level = stored(wanted.select("doc", "id").distinct().join(up, ["doc", "id"]), "subtree")
    every = level.select("doc", "id")
    for _ in range(depth):
        above = level.select("doc", F.col("parent").alias("id")).where("id IS NOT NULL").distinct().join(every, ["doc", "id"], "left_anti")
        level = stored(above.join(up, ["doc", "id"]), "subtree")
        if level.isEmpty():
            break
        every = every.unionByName(level.select("doc", "id"))
    return every


def expanded(uses: DataFrame, depth: int = DEEPEST) -> DataFrame:
    """REC1, REC2, JOIN3, FIL3: absolute intervals of leaves through nested containers, with what they inherit.

    uses: doc, media (the container it stands in; NULL: the main storyline), ref (what it shows), off, start, len, leaf; and,
    where there are such columns, stretch (whole: times slower than its container), enabled, gain, role, frame.
    An inner item at `off` of a container used with origin o, inner start s, clock k and bounds [b, e) lies at
    o + k (off - s), is k times as long, and is clipped to [b, e). Clocks multiply on the way down, so source times are kept as
    source / clock. An item is enabled if all above it are; gains multiply; role and frame are the innermost that is set.
    A path that meets a container again is cut there with reason 'cycle', one beyond `depth` with 'deep'.

    Level by level: each frontier is written before the next, so rows have no limit and a plan holds one join.
    """
    has = set(uses.columns)
    use = stored(
        uses.select(
            "doc", "media", "ref", "off", "start", "len", "leaf",
            (F.col("stretch") if "stretch" in has else F.lit(1)).cast("long").alias("stretch"),
            (F.col("enabled") if "enabled" in has else F.lit(True)).alias("enabled"),
            (F.col("gain") if "gain" in has else F.lit(1)).alias("gain"),
            (F.col("role") if "role" in has else F.lit(None).cast("string")).alias("role"),
            (F.col("frame") if "frame" in has else F.lit(None).cast("string")).alias("frame"),
        ),
        "uses",
    )
    inner = use.select("doc", F.col("media").alias("ref"), *[F.col(c).alias(f"u_{c}") for c in use.columns if c not in ("doc", "media")])
    top = use.where("media IS NULL").select("doc", "ref", "leaf", F.col("off").alias("origin"), "start", F.col("off").alias("b"), (F.col("off") + F.col("len") * F.col("stretch")).alias("e"), F.array("ref").alias("path"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("reason"), F.col("stretch").alias("clock"), "enabled", "gain", "role", "frame")
    level = stored(top, "frontier")
    every = level
    for k in range(1, depth + 1):
        met = level.where("NOT leaf AND reason IS NULL").join(inner, ["doc", "ref"])
        at = F.col("origin") + F.col("clock") * (F.col("u_off") - F.col("start"))
        clock = F.col("clock") * F.col("u_stretch")
        met = met.withColumn("at", at).withColumn("low", F.greatest("b", "at")).withColumn("high", F.least(F.col("e"), F.col("at") + clock * F.col("u_len"))).where("low < high")
        reason = F.when(F.array_contains("path", F.col("u_ref")), "cycle").when(F.lit(k >= depth), "deep")
        below = met.select(
            "doc", F.col("u_ref").alias("ref"), F.col("u_leaf").alias("leaf"), F.col("at").alias("origin"), F.col("u_start").alias("start"), F.col("low").alias("b"), F.col("high").alias("e"),
            F.concat("path", F.array("u_ref")).alias("path"), F.lit(k).alias("depth"), reason.alias("reason"), clock.alias("clock"),
            (F.col("enabled") & F.col("u_enabled")).alias("enabled"), (F.col("gain") * F.col("u_gain")).alias("gain"), F.coalesce("u_role", "role").alias("role"), F.coalesce("u_frame", "frame").alias("frame"),
        )
        level = stored(below, "frontier")
        if level.isEmpty():
            break
        every = every.unionByName(level)
    source = (F.col("b") - F.col("origin") + F.col("clock") * F.col("start")).alias("source")
    return every.where("leaf OR reason IS NOT NULL").select("doc", "ref", "b", "e", source, "clock", "depth", "reason", "enabled", "gain", "role", "frame")


#: Rules of the strict reader: frames a second, clips, frames, and the attributes that it knows.
STRICT_FPS, MOST_CLIPS, MOST_FRAMES, MOST_SECONDS = 25, 64, 750, 4 * 3600
CLIP_ATTRIBUTES = ("offset", "duration", "name", "start", "ref")


def frames_of(time: Column, fps: int = STRICT_FPS) -> Column:
    """A wire time as a whole number of frames; NULL off the grid."""
    t = R.parse(time)
    return F.when((t["num"] * fps) % t["den"] == 0, R.floor_div((t["num"] * fps).cast("long"), t["den"].cast("long")))


def header(nodes: DataFrame) -> DataFrame:
    """SRC3: doc, uid, duration (a reduced fraction), frame, allowed (four hours at the most) of each document that was read."""
    sequence = nodes.where("tag = 'sequence'").select("doc", F.col("parent").alias("id"), F.col("attrs")["duration"].alias("duration"), F.col("attrs")["format"].alias("format"))
    project = nodes.where("tag = 'project'").select("doc", "id", F.col("attrs")["uid"].alias("uid"))
    formats = nodes.where("tag = 'format'").select("doc", F.col("attrs")["id"].alias("format"), F.col("attrs")["frameDuration"].alias("frame"))
    t = R.parse(F.col("duration"))
    return project.join(sequence, ["doc", "id"]).join(formats, ["doc", "format"], "left").select("doc", "uid", R.show(t).alias("duration"), R.show(R.parse(F.col("frame"))).alias("frame"), (t["num"] <= t["den"] * MOST_SECONDS).alias("allowed"))


def strict(nodes: DataFrame) -> DataFrame:
    """SRC4: doc, reason (NULL: accepted), clips, frames. The first rule that is broken: frame, clips, attributes, grid, tiles, length."""
    spine = nodes.where("tag = 'spine'").select("doc", F.col("id").alias("parent"))
    clip = nodes.join(spine, ["doc", "parent"]).select("doc", "ord", frames_of(F.col("attrs")["offset"]).alias("a"), frames_of(F.col("attrs")["duration"]).alias("n"), (F.size(F.array_except(F.map_keys("attrs"), F.array(*map(F.lit, CLIP_ATTRIBUTES)))) > 0).alias("strange"))
    so_far = Window.partitionBy("doc").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    laid = clip.withColumn("broken", F.col("a") != F.coalesce(F.sum("n").over(so_far), F.lit(0)))
    rules = laid.groupBy("doc").agg(F.count(F.lit(1)).alias("clips"), F.sum("n").alias("frames"), F.max("strange").alias("strange"), F.max(F.col("a").isNull() | F.col("n").isNull()).alias("off"), F.max("broken").alias("broken"))
    frame = header(nodes).select("doc", "frame")
    reason = (
        F.when(F.coalesce(F.col("frame") != f"1/{STRICT_FPS}", F.lit(True)), "frame")
        .when(F.col("clips") > MOST_CLIPS, "clips")
        .when(F.col("strange"), "attributes")
        .when(F.col("off"), "grid")
        .when(F.col("broken"), "tiles")
        .when(F.col("frames") > MOST_FRAMES, "length")
    )
    return rules.join(frame, "doc", "left").select("doc", reason.alias("reason"), "clips", "frames")


def read_back(nodes: DataFrame) -> DataFrame:
    """SRC5: doc, clips, and the titles of documents as they would be shown: start and end frame, name, in order."""
    spine = nodes.where("tag = 'spine'").select("doc", F.col("id").alias("parent"))
    rows = nodes.join(spine, ["doc", "parent"]).withColumn("a", frames_of(F.col("attrs")["offset"])).withColumn("n", frames_of(F.col("attrs")["duration"]))
    return rows.where("tag IN ('title', 'clip')").select("doc", "ord", F.col("a").alias("start_frame"), (F.col("a") + F.col("n")).alias("end_frame"), F.col("attrs")["name"].alias("name"))
