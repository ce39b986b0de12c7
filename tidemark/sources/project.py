"""From project documents to absolute plans: a walk over ordered node tables, level by level (SRC1, REC1, REC2, JOIN3, JOIN4, WIN13).

Every item stands in a context: a clock, and a set of pieces [c0, c1) of that clock, each with the interval [a0, a1) of project time where
it is seen. An item lies at base + offset of its context's clock. Its time map (or none: one even segment) splits what the
context's pieces show of it at the map's break points: its spans, with the time of its own inner clock beside project time. Then

* contained items, and those of the media or of the chosen angles that it refers to, stand in a context of its spans, on its inner clock;
* anchored items (lane) stand in its own context, beside it: its map and its bounds do not hold for them;
* items of a secondary storyline stand in that storyline's context, from its place on.

So maps compose on the way down, each level splitting the pieces that came to it, by exact fractions of any size. A reversed, frozen or smoothed map
cannot be followed: the item's visible interval is told with the reason, and what it contains is not walked. So are a
media that contains itself, one that is missing, an unknown or doubled angle, and items deeper than DEEPEST.

Each level is two joins by (document, node) and one written table; plans hold no more, and rows have no limit. The fractions
themselves are worked out row by row in a small Arrow function, because products of their denominators leave 128 bits.

Defined results: NULL attributes have the format's defaults; a time that cannot be read gives the reason 'time'; items of no length have no
spans; ties of order do not matter. Documents without a project give no rows. Other columns of the nodes are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.shared import scratch, stored
from tidemark.sources.timeline import DEEPEST

STORY = ("asset-clip", "gap", "clip", "audio", "video", "ref-clip", "sync-clip", "mc-clip", "spine")
#: A frozen lead shorter than this is dropped, not refused.
LEAD = Fraction(1, 1000)
DB = "decimal(12,4)"
_TIME = re.compile(r"(-?\d+)(?:/(\d+))?s?")


def fraction(text: str | None) -> Fraction | None:
    """A time as documents write it ('3/25s') or as this module does ('3/25')."""
    m = _TIME.fullmatch(text or "0s")
    return Fraction(int(m[1]), int(m[2] or 1)) if m and int(m[2] or 1) else None


def segments_of(start: Fraction, length: Fraction, points: list[dict] | None) -> tuple[list[tuple], str | None]:
    """WIN13: (out0, out1, in0, in1) from the item's begin, in order, or the reason why the map cannot be followed."""
    if not points:
        return [(Fraction(0), length, start, start + length)], None
    read = [(fraction(p["time"]), fraction(p["value"])) for p in points]
    if any(x is None for p in read for x in p):
        return [], "points"
    if any(p["bent"] for p in points):
        return [], "smooth"
    if len(read) < 2 or read[0][0] > start or read[-1][0] < start + length or any(b[0] <= a[0] for a, b in zip(read, read[1:], strict=False)):
        return [], "points"
    out = []
    for (t0, v0), (t1, v1) in zip(read, read[1:], strict=False):
        low, high = max(t0, start), min(t1, start + length)
        if low >= high:
            continue
        if v1 < v0:
            return [], "reverse"
        if v1 == v0:
            if high - low > LEAD:
                return [], "freeze"
            continue
        rate = (v1 - v0) / (t1 - t0)
        out.append((low - start, high - start, v0 + rate * (low - t0), v0 + rate * (high - t0)))
    return out, None if out else "freeze"


def spans_of(pieces: list[tuple], origin: Fraction, segments: list[tuple]) -> list[tuple]:
    """(in0, in1, a0, a1): where the segments meet the pieces; both are in order, so one pass over each."""
    out, i, j = [], 0, 0
    while i < len(pieces) and j < len(segments):
        c0, c1, a0, a1 = pieces[i]
        o0, o1, s0, s1 = segments[j]
        low, high = max(c0, origin + o0), min(c1, origin + o1)
        if low < high:
            shown, told = (a1 - a0) / (c1 - c0), (s1 - s0) / (o1 - o0)
            out.append((s0 + told * (low - origin - o0), s0 + told * (high - origin - o0), a0 + shown * (low - c0), a0 + shown * (high - c0)))
        if c1 <= origin + o1:
            i += 1
        else:
            j += 1
    return out


def written(piece: tuple) -> str:
    return " ".join(map(str, piece))


def placed(level: DataFrame) -> DataFrame:
    """level with origin, anchor (origin - start) and spans of each item, and the reason if its map cannot be followed; its spans are then those without it."""
    added = [("origin", pa.string()), ("anchor", pa.string()), ("spans", pa.list_(pa.string())), ("reason", pa.string())]
    carried = [c for c in level.columns if c != "points"]
    schema = ", ".join(f"`{c}` {level.schema[c].dataType.simpleString()}" for c in carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for base, off, start, length, points, pieces, cycle in zip(*[b.column(c).to_pylist() for c in ("base", "off", "start", "len", "points", "pieces", "halt")], strict=True):
                times = [fraction(x) for x in (base, off, start, length)]
                if any(x is None for x in times) or times[3] < 0:
                    out.append((None, None, [], "time"))
                    continue
                origin = times[0] + times[1]
                context = [tuple(map(Fraction, p.split())) for p in pieces]
                segments, reason = segments_of(times[2], times[3], points)
                reason = cycle or reason
                if reason:
                    segments = [(Fraction(0), times[3], times[2], times[2] + times[3])]
                out.append((str(origin), str(origin - times[2]), [written(p) for p in spans_of(context, origin, segments)], reason))
            cols = list(zip(*out, strict=True)) or [[]] * len(added)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in carried], *[pa.array(c, t) for c, (_, t) in zip(cols, added, strict=True)]], [*carried, *[n for n, _ in added]])

    return level.mapInArrow(run, f"{schema}, origin string, anchor string, spans array<string>, reason string")


def decibels(text: Column) -> Column:
    """MAT6: the amount of a volume, '-6dB', exactly."""
    return F.regexp_extract(F.coalesce(text, F.lit("0dB")), r"^\s*([+-]?[0-9]+(?:\.[0-9]+)?)\s*dB\s*$", 1).try_cast(DB)


def items_of(nodes: DataFrame) -> DataFrame:
    """A row for each item of a story, with what its resources and children say of it."""
    a = lambda name: F.col("attrs")[name]
    below = lambda tag: nodes.where(F.col("tag") == tag).select("doc", F.col("parent").alias("id"), F.col("id").alias("inner"), "ord", "attrs")
    asset = nodes.where("tag = 'asset'").select("doc", a("id").alias("ref"), a("start").alias("asset_start"), a("duration").alias("asset_len"), (a("hasAudio") == "1").alias("heard"), F.coalesce(a("audioRate").try_cast("int"), F.lit(48000)).alias("asset_rate"))
    media = nodes.where("tag = 'media'").select("doc", "id", a("id").alias("ref"))
    sequence = media.join(below("sequence"), ["doc", "id"]).select("doc", "ref", a("tcStart").alias("media_start"))
    point = below("timept").select("doc", F.col("id").alias("inner"), F.struct("ord", a("time").alias("time"), a("value").alias("value"), ((F.coalesce(a("interp"), F.lit("smooth2")) != "linear") | a("inTime").isNotNull() | a("outTime").isNotNull()).alias("bent")).alias("p"))
    points = below("timeMap").select("doc", "id", "inner").join(point, ["doc", "inner"]).groupBy("doc", "id").agg(F.transform(F.array_sort(F.collect_list("p")), lambda p: F.struct(p["time"].alias("time"), p["value"].alias("value"), p["bent"].alias("bent"))).alias("points"))
    volume = below("adjust-volume").groupBy("doc", "id").agg(F.sum(decibels(a("amount"))).alias("own_db"))
    item = nodes.where(F.col("tag").isin(*STORY, "title")).select(
        "doc", "id", "parent", "tag", a("ref").alias("ref"), a("offset").alias("off"), a("start").alias("start"), a("duration").alias("len"), F.coalesce(a("lane"), F.lit("0")).alias("lane"), (F.coalesce(a("enabled"), F.lit("1")) == "1").alias("own_on"),
        F.coalesce(a("srcEnable"), F.lit("all")).alias("source"), F.split(F.coalesce(a("audioRole"), a("role"), F.lit("dialogue")), r"\.")[0].alias("role"), F.coalesce(a("name"), F.concat(F.lit("#"), F.col("id").cast("string"))).alias("name"),
    )
    out = item.join(asset, ["doc", "ref"], "left").join(sequence, ["doc", "ref"], "left").join(points, ["doc", "id"], "left").join(volume, ["doc", "id"], "left")
    start = F.coalesce("start", F.when(F.col("tag").isin("asset-clip", "audio"), F.col("asset_start")), F.when(F.col("tag").isin("ref-clip", "mc-clip"), F.col("media_start")))
    length = F.coalesce("len", F.when(F.col("tag").isin("asset-clip", "audio"), F.col("asset_len")))
    return out.withColumn("start", start).withColumn("len", length).withColumn("mapped", F.col("points").isNotNull()).withColumn("own_db", F.coalesce("own_db", F.lit(0).cast(DB)))


def holders_of(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc, id, holder of items that refer to others: the media's storyline, or the angles that are heard (JOIN4); and doc, id of those whose reference is broken, with the reason."""
    a = lambda name: F.col("attrs")[name]
    named = lambda tag, *more: nodes.where(F.col("tag") == tag).select("doc", "id", "parent", *more)
    media = named("media", a("id").alias("ref")).select("doc", F.col("id").alias("parent"), "ref")
    sequence = named("sequence").join(media, ["doc", "parent"]).select("doc", F.col("id").alias("parent"), "ref")
    spine = named("spine").join(sequence, ["doc", "parent"]).select("doc", "ref", F.col("id").alias("holder"))
    refs = named("ref-clip", a("ref").alias("ref")).drop("parent")
    by_media = refs.join(spine, ["doc", "ref"], "left")
    multicam = named("multicam").join(media, ["doc", "parent"]).select("doc", F.col("id").alias("parent"), "ref")
    angle = named("mc-angle", a("angleID").alias("angle")).join(multicam, ["doc", "parent"]).groupBy("doc", "ref", "angle").agg(F.min("id").alias("holder"), F.count(F.lit(1)).alias("alike"))
    chosen = named("mc-source", a("angleID").alias("angle"), F.coalesce(a("srcEnable"), F.lit("all")).alias("use")).select("doc", F.col("parent").alias("id"), "angle", "use")
    cams = named("mc-clip", a("ref").alias("ref")).drop("parent")
    met = cams.join(chosen, ["doc", "id"], "left").join(angle, ["doc", "ref", "angle"], "left")
    broken = met.groupBy("doc", "id").agg((F.count("holder") < F.count(F.lit(1))).alias("lost"), (F.count("angle") > F.countDistinct("angle")).alias("twice"), (F.max("alike") > 1).alias("alike")).where("lost OR twice OR alike")
    halted = by_media.where("holder IS NULL").select("doc", "id", F.lit("missing").alias("broken")).unionByName(broken.select("doc", "id", F.lit("angle").alias("broken")))
    found = by_media.where("holder IS NOT NULL").select("doc", "id", "holder").unionByName(met.where("use IN ('all', 'audio') AND holder IS NOT NULL").select("doc", "id", "holder"))
    return found, halted


def walked(nodes: DataFrame, mode: str = "dialogue", depth: int = DEEPEST) -> DataFrame:
    """REC1, REC2: every item that is reached, once for each way to it: doc, path (names), item's columns, on, db, warped, spans, reason.

    spans: 'in0 in1 a0 a1' of each piece that is seen. Flags and gains pass from an item to what it contains; what is anchored to it has
    those that the item itself was given. mode 'dialogue' leaves music and effects out."""
    silent = F.col("role").isin("music", "effects") if mode == "dialogue" else F.lit(False)
    with scratch(nodes.sparkSession):
        item, edge, holds, frontier = tables_of(nodes)
        done: list[DataFrame] = []
        for k in range(depth + 1):
            met = frontier.join(item, ["doc", "id"]).withColumn("path", F.concat("above", F.when(F.col("above") == "", "").otherwise("/"), "name"))
            halt = F.when(F.col("tag").isin("ref-clip", "mc-clip") & F.array_contains("stack", F.col("ref")), "cycle").when(F.col("broken").isNotNull(), F.col("broken")).when(F.lit(k == depth), "deep")
            level = stored(placed(met.withColumn("halt", halt)), "level")
            if done and level.isEmpty():
                break
            done.append(level)
            below = level.where("reason IS NULL OR reason IN ('smooth', 'reverse', 'freeze', 'points')").join(holds, ["doc", "id"]).join(edge, ["doc", "holder"])
            own, story = F.col("relation") == "contained", F.col("tag") == "spine"
            inner = own & ~story
            hears = F.col("own_on") & F.col("given_on") & (F.col("source") != "video") & ~(F.col("tag").isin("ref-clip", "mc-clip") & silent)
            frontier = below.where(~own | F.col("reason").isNull()).select(
                "doc", F.col("child").alias("id"), F.col("path").alias("above"), F.when(F.col("tag").isin("ref-clip", "mc-clip") & own, F.concat("stack", F.array("ref"))).otherwise(F.col("stack")).alias("stack"),
                F.when(story, F.col("origin")).when(own, F.lit("0")).otherwise(F.col("anchor")).alias("base"), F.when(inner, F.col("spans")).otherwise(F.col("pieces")).alias("pieces"),
                # What a synchronized clip holds follows it, anchored or not.
                F.when(inner | (F.col("tag") == "sync-clip"), hears).otherwise(F.col("given_on")).alias("given_on"),
                F.when(inner | (F.col("tag") == "sync-clip"), F.col("given_db") + F.col("own_db")).otherwise(F.col("given_db")).cast(DB).alias("given_db"),
                (F.col("warped") | (inner & F.col("mapped"))).alias("warped"),
            ).where(F.size("pieces") > 0)
        every = done[0]
        for x in done[1:]:
            every = every.unionByName(x)
        return stored(every, "walk", keep=True)


def tables_of(nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Items; (doc, holder, child, relation); (doc, id, holder) of what an item holds; and the items of each project's storyline, in project time."""
    a = lambda name: F.col("attrs")[name]
    read = stored(items_of(nodes), "items")
    more, halted = holders_of(nodes)
    parents = nodes.select("doc", F.col("id").alias("parent"), F.col("tag").alias("parent_tag"))
    relation = F.when(F.col("parent_tag").isin("spine", "mc-angle") | (F.col("lane") == "0"), "contained").otherwise("anchored")
    edge = stored(read.join(parents, ["doc", "parent"]).select("doc", F.col("parent").alias("holder"), F.col("id").alias("child"), relation.alias("relation")), "edges")
    holds = stored(read.select("doc", "id", F.col("id").alias("holder")).unionByName(more), "holders")
    item = stored(read.join(halted, ["doc", "id"], "left"), "story")
    project = nodes.where("tag = 'project'").select("doc", F.col("id").alias("parent"))
    sequence = nodes.where("tag = 'sequence'").join(project, ["doc", "parent"]).select("doc", F.col("id").alias("parent"), F.regexp_replace(a("duration"), "s$", "").alias("whole"), F.regexp_replace(F.coalesce(a("tcStart"), F.lit("0s")), "s$", "").alias("tc"))
    spine = nodes.where("tag = 'spine'").join(sequence, ["doc", "parent"]).select("doc", F.col("id").alias("holder"), "whole", F.when(F.col("tc").startswith("-"), F.substring("tc", 2, 99)).otherwise(F.concat(F.lit("-"), "tc")).alias("base"))
    first = spine.where("whole IS NOT NULL").join(edge, ["doc", "holder"]).select("doc", F.col("child").alias("id"), F.lit("").alias("above"), F.array().cast("array<string>").alias("stack"), "base", F.array(F.concat_ws(" ", F.lit("0"), "whole", F.lit("0"), "whole")).alias("pieces"), F.lit(True).alias("given_on"), F.lit(0).cast(DB).alias("given_db"), F.lit(False).alias("warped"))
    return item, edge, holds, first


def told(rows: DataFrame, schema: str, names: list[str], each) -> DataFrame:  # noqa: ANN001
    """each(row, its spans as fractions) gives rows of the schema."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kinds = list(to_arrow_schema(_parse_datatype_string(schema)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [x for row in b.to_pylist() for x in each(row, [tuple(map(Fraction, s.split())) for s in row["spans"]])]
            cols = list(zip(*out, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(cols, kinds, strict=True)], names)

    return rows.mapInArrow(run, schema)


def plan(walk: DataFrame, mode: str = "dialogue", rate: int = 16000) -> DataFrame:
    """doc, path, asset, offset, duration, source, source_len (fractions of a second), start_sample, samples, db, role, reason.

    A row for each piece of sound that is heard; and, with its reason and without a source, for each piece of an item that cannot be followed,
    whose role is left out ('role'), or whose source does not reach so far ('range'; beyond its end by a sample of its own is no fault: TIM7)."""
    heard = F.col("own_on") & F.col("given_on") & (F.col("source") != "video")
    leaf = F.col("tag").isin("asset-clip", "audio") & F.col("heard")
    rows = walk.where(heard & (F.col("reason").isNotNull() | leaf)).withColumn("excluded", F.col("role").isin("music", "effects") & F.lit(mode == "dialogue"))
    cols = ["doc", "path", "ref", "spans", "reason", "excluded", "role", "asset_start", "asset_len", "asset_rate", (F.col("given_db") + F.col("own_db")).cast(DB).alias("db")]
    kind = walk.schema["doc"].dataType.simpleString()
    sample = lambda t: int((t * rate + Fraction(1, 2)).__floor__())

    def each(r: dict, spans: list[tuple]) -> Iterator[tuple]:
        begin, whole = fraction(r["asset_start"]), fraction(r["asset_len"])
        for in0, in1, a0, a1 in spans:
            reason = r["reason"] or ("role" if r["excluded"] else None)
            source = end = None
            if not reason:
                source, end = in0 - begin, in1 - begin
                if whole < end <= whole + Fraction(1, r["asset_rate"]):
                    end = whole
                if source < 0 or end > whole or end <= source:
                    reason, source = "range", None
            first = sample(a0)
            yield r["doc"], r["path"], r["ref"], str(a0), str(a1 - a0), None if source is None else str(source), None if source is None else str(end - source), first, sample(a1) - first, r["db"], r["role"], reason

    names = ["doc", "path", "asset", "offset", "duration", "source", "source_len", "start_sample", "samples", "db", "role", "reason"]
    return told(rows.select(*cols), f"doc {kind}, path string, asset string, offset string, duration string, source string, source_len string, start_sample long, samples long, db {DB}, role string, reason string", names, each)


def titles(walk: DataFrame, frames: DataFrame) -> DataFrame:
    """REC2: doc, path, begin, end (the hull of what is seen, in seconds), pieces, warped, start_frame, end_frame, exact of each title that is seen.

    frames: doc, frame (seconds as a fraction). Frames cover the hull; exact tells whether it lies on the grid."""
    rows = walk.where("tag = 'title' AND size(spans) > 0").join(frames.select("doc", "frame"), "doc").select("doc", "path", "spans", "warped", "own_on", "frame")
    kind = walk.schema["doc"].dataType.simpleString()

    def each(r: dict, spans: list[tuple]) -> Iterator[tuple]:
        begin, end, frame = min(s[2] for s in spans), max(s[3] for s in spans), fraction(r["frame"])
        a, b = begin / frame, end / frame
        yield r["doc"], r["path"], str(begin), str(end), len(spans), r["warped"], r["own_on"], a.__floor__(), b.__ceil__(), a.denominator == b.denominator == 1

    names = ["doc", "path", "begin", "end", "pieces", "warped", "enabled", "start_frame", "end_frame", "exact"]
    return told(rows, f"doc {kind}, path string, begin string, end string, pieces int, warped boolean, enabled boolean, start_frame long, end_frame long, exact boolean", names, each)
