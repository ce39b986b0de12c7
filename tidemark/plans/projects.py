"""Queries over whole project documents: plans and titles, from files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.plans.derive import table
from tidemark.shared import folder
from tidemark.sources import project as P
from tidemark.sources import timeline as N

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):  # noqa: ANN201
    def register(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


#: A nation's project: its suppliers are the clips of the storyline, of a kind by their key; four media lie one in the other, the fifth in itself.
#: Times are whole frames (1/25 s) but for the ends of maps, which are halves. a0, a1: what the assets begin with; d: their length.
ITEMS = """
su AS (SELECT s_nationkey AS doc, s_suppkey AS k, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS ord, (s_suppkey % 7 + 4)::BIGINT AS n FROM supplier),
sp AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY doc ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a FROM su),
docs AS (SELECT doc, sum(n)::BIGINT AS whole FROM su GROUP BY doc),
kind AS (SELECT doc, k, k % 8 AS kind, n, a, 's' || k AS name, k % 3 AS r, CASE k % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 6 END AS s2 FROM sp),
item(doc, id, holder, side, tag, ref, off, start, len, ramp, db, is_on, role) AS (
    SELECT doc, name, 'top', true, CASE WHEN kind IN (0, 5) THEN 'asset' WHEN kind IN (1, 2, 3, 7) THEN 'ref' ELSE 'box' END,
           CASE kind WHEN 0 THEN 'a1' WHEN 1 THEN 'm' || k % 4 WHEN 2 THEN 'm' || k % 4 WHEN 3 THEN 'g' || k % 2 WHEN 5 THEN 'a1' WHEN 7 THEN 'm4' END,
           a, CASE WHEN kind IN (0, 1) THEN r WHEN kind = 4 THEN 1 ELSE 0 END, n, CASE kind WHEN 2 THEN s2 WHEN 5 THEN -1 ELSE 0 END,
           CASE kind WHEN 0 THEN CASE WHEN r = 1 THEN -6 ELSE 0 END WHEN 1 THEN -(k % 4) ELSE 0 END, k % 16 <> 15, CASE WHEN k % 16 = 8 THEN 'music' ELSE 'dialogue' END FROM kind
    UNION ALL SELECT doc, name || 'in', name, true, 'asset', 'a2', 0, 15, n + 2, 0, 0, true, 'dialogue' FROM kind WHERE kind = 4
    UNION ALL SELECT doc, name || 'up', name, false, 'asset', 'a1', 2, 0, n, 0, -3, true, 'dialogue' FROM kind WHERE kind IN (4, 5)
    UNION ALL SELECT doc, name || 't', name, false, 'title', NULL, 1, 0, 3, 0, 0, true, NULL FROM kind WHERE kind IN (4, 6)
    UNION ALL SELECT doc, 'x' || m, 'm' || m, true, 'asset', 'a1', 0, m, 6, 0, 0, true, 'dialogue' FROM docs, range(4) t(m)
    UNION ALL SELECT doc, 'y' || m, 'm' || m, true, CASE WHEN m < 3 THEN 'ref' ELSE 'asset' END, CASE WHEN m < 3 THEN 'm' || m + 1 ELSE 'a2' END, 6, CASE WHEN m = 3 THEN 10 ELSE 0 END, 8, CASE WHEN m < 3 THEN 1 + m ELSE 0 END, -1, true, 'dialogue' FROM docs, range(4) t(m)
    UNION ALL SELECT doc, 'z' || m, 'y' || m, false, 'title', NULL, 2, 0, 9, 0, 0, true, NULL FROM docs, range(4) t(m)
    UNION ALL SELECT doc, 'c', 'm4', true, 'asset', 'a2', 0, 10, 3, 0, 0, true, 'dialogue' FROM docs
    UNION ALL SELECT doc, 'l', 'm4', true, 'ref', 'm4', 3, 0, 5, 0, 0, true, 'dialogue' FROM docs
    UNION ALL SELECT doc, 'p', 'g0', true, 'asset', 'a1', 0, 2, 30, 0, 0, true, 'dialogue' FROM docs
    UNION ALL SELECT doc, 'q', 'g1', true, 'asset', 'a2', 5, 10, 25, 0, 0, true, 'dialogue' FROM docs)
"""
#: Ticks of a frame: maps double, keep, or treble the speed, or halve it, at most four times one in the other.
TICK = 1296
#: Pieces on their way down, in ticks: an item in a piece [c0, c1) of its context, shown at a0 + (c - c0) den / num. A ramp shows its first two
#: frames at double speed, then `ramp` half frames of source a frame.
WALK = f"""
seg AS (
    SELECT doc, id, 0 AS o0, len * {TICK} AS o1, start * {TICK} AS i0, 1 AS num, 1 AS den FROM item WHERE ramp <= 0
    UNION ALL SELECT doc, id, 0, 2 * {TICK}, 0, 2, 1 FROM item WHERE ramp > 0
    UNION ALL SELECT doc, id, 2 * {TICK}, len * {TICK}, 4 * {TICK}, ramp, 2 FROM item WHERE ramp > 0),
w(doc, id, path, stack, base, c0, c1, a0, num, den, is_on, db, warped) AS (
    SELECT item.doc, id, id, []::VARCHAR[], 0::HUGEINT, 0::HUGEINT, (whole * {TICK})::HUGEINT, 0::HUGEINT, 1::HUGEINT, 1::HUGEINT, true, 0, false FROM item JOIN docs USING (doc) WHERE holder = 'top'
    UNION ALL
    SELECT w.doc, c.id, w.path || '/' || c.id, CASE WHEN c.side AND i.tag = 'ref' THEN list_append(w.stack, i.ref) ELSE w.stack END,
           CASE WHEN c.side THEN 0 ELSE w.base + (i.off - i.start) * {TICK} END,
           CASE WHEN c.side THEN s.i0 + (greatest(w.c0, o.pos + s.o0) - o.pos - s.o0) * s.num // s.den ELSE w.c0 END, CASE WHEN c.side THEN s.i0 + (least(w.c1, o.pos + s.o1) - o.pos - s.o0) * s.num // s.den ELSE w.c1 END,
           CASE WHEN c.side THEN w.a0 + (greatest(w.c0, o.pos + s.o0) - w.c0) * w.den // w.num ELSE w.a0 END,
           CASE WHEN c.side THEN w.num * s.num ELSE w.num END, CASE WHEN c.side THEN w.den * s.den ELSE w.den END,
           CASE WHEN c.side THEN w.is_on AND i.is_on ELSE w.is_on END, CASE WHEN c.side THEN w.db + i.db ELSE w.db END, w.warped OR (c.side AND i.ramp <> 0)
    FROM w JOIN item i ON i.doc = w.doc AND i.id = w.id JOIN LATERAL (SELECT w.base + i.off * {TICK} AS pos) o ON true
    JOIN item c ON c.doc = w.doc AND (c.holder = i.id OR (i.tag = 'ref' AND c.holder = i.ref AND i.ramp >= 0 AND NOT list_contains(w.stack, i.ref)))
    JOIN seg s ON s.doc = i.doc AND s.id = i.id AND (c.side OR s.o0 = 0)
    WHERE NOT c.side OR greatest(w.c0, o.pos + s.o0) < least(w.c1, o.pos + s.o1)),
seen AS (
    SELECT w.*, i.tag, i.ref, i.role, i.ramp, i.is_on AS own_on, i.db AS own_db, i.tag = 'ref' AND list_contains(w.stack, i.ref) AS loops, s.num AS snum, s.den AS sden,
           s.i0 + (greatest(w.c0, pos + s.o0) - pos - s.o0) * s.num // s.den AS i0, w.a0 + (greatest(w.c0, pos + s.o0) - w.c0) * w.den // w.num AS b, w.a0 + (least(w.c1, pos + s.o1) - w.c0) * w.den // w.num AS e
    FROM (SELECT w.*, w.base + i.off * {TICK} AS pos FROM w JOIN item i USING (doc, id)) w JOIN item i USING (doc, id) JOIN seg s USING (doc, id) WHERE greatest(w.c0, pos + s.o0) < least(w.c1, pos + s.o1))
"""
shown = lambda x: f"(({x}) // gcd(({x})::BIGINT, {25 * TICK}))::VARCHAR || CASE WHEN ({x}) % {25 * TICK} = 0 THEN '' ELSE '/' || ({25 * TICK} // gcd(({x})::BIGINT, {25 * TICK})) END"


def written_timelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of project files, one for each nation, written to the shared folder and read again."""
    k, n = F.col("k"), F.col("n")
    t = lambda c, per=25: F.concat(c.cast("string") if isinstance(c, Column) else F.lit(str(c)), F.lit(f"/{per}s"))

    def x(tag: str, inner: Column | str = "", **attrs: Column | str | int) -> Column:
        """An element; times are frames."""
        parts = [F.lit(f"<{tag}")]
        for name, v in attrs.items():
            parts += [F.lit(f' {name}="'), t(v) if name in ("offset", "start", "duration") else v if isinstance(v, Column) else F.lit(str(v)), F.lit('"')]
        return F.concat(*parts, F.lit(">"), inner if isinstance(inner, Column) else F.lit(inner), F.lit(f"</{tag}>"))

    def ramp(length: Column | int, halves: Column | int) -> Column:
        length, halves = (v if isinstance(v, Column) else F.lit(v) for v in (length, halves))
        point = lambda time, value: F.concat(F.lit('<timept interp="linear" time="'), time, F.lit('" value="'), value, F.lit('"/>'))
        return F.concat(F.lit("<timeMap>"), point(F.lit("0s"), F.lit("0s")), point(F.lit("2/25s"), F.lit("4/25s")), point(t(length), t(8 + (length - 2) * halves, 50)), F.lit("</timeMap>"))

    name = F.concat(F.lit("s"), k.cast("string"))
    sub = lambda what: F.concat(name, F.lit(what))
    kind, r = k % 8, k % 3
    on = F.when(k % 16 == 15, "0").otherwise("1")
    at = {"name": name, "offset": F.col("a"), "duration": n, "enabled": on}
    media = lambda m: F.concat(F.lit("m"), (m).cast("string"))
    volume = lambda db: F.concat(F.lit('<adjust-volume amount="'), db.cast("string"), F.lit('dB"/>'))
    up = x("asset-clip", volume(F.lit(-3)), name=sub("up"), ref="a1", lane="1", offset=2, duration=n, start=0)
    over = lambda lane: x("title", name=sub("t"), ref="e1", lane=lane, offset=1, duration=3)
    s2 = F.when(r == 0, 1).when(r == 1, 2).otherwise(6)
    back = F.concat(F.lit('<timeMap><timept interp="linear" time="0s" value="4s"/><timept interp="linear" time="9s" value="0s"/></timeMap>'), up)
    angle = lambda i, use: F.concat(F.lit('<mc-source angleID="g'), i.cast("string"), F.lit(f'" srcEnable="{use}"/>'))
    clip = (
        F.when(kind == 0, x("asset-clip", F.when(r == 1, volume(F.lit(-6))).otherwise(""), ref="a1", start=r, audioRole=F.when(k % 16 == 8, "music.a").otherwise("dialogue.b"), **at))
        .when(kind == 1, x("ref-clip", volume(-(k % 4)), ref=media(k % 4), start=r, **at))
        .when(kind == 2, x("ref-clip", ramp(n, s2), ref=media(k % 4), **at))
        .when(kind == 3, x("mc-clip", F.concat(angle(k % 2, "all"), angle(1 - k % 2, "video")), ref="mc", start=0, **at))
        .when(kind == 4, x("clip", F.concat(x("asset-clip", name=sub("in"), ref="a2", offset=0, duration=n + 2, start=15), up, over("2")), start=1, **at))
        .when(kind == 5, x("asset-clip", back, ref="a1", **at))
        .when(kind == 6, x("gap", over("1"), **at))
        .otherwise(x("ref-clip", ref="m4", **at))
    )
    su = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("doc"), F.col("s_suppkey").alias("k"), (F.col("s_suppkey") % 7 + 4).cast("long").alias("n"))
    before = Window.partitionBy("doc").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    clips = su.withColumn("a", F.coalesce(F.sum("n").over(before), F.lit(0)))
    docs = clips.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", clip.alias("x")))), lambda c: c["x"]), "").alias("clips"), F.sum("n").alias("whole"))
    inner = []
    for m in range(4):
        head = f'<media id="m{m}"><sequence duration="100s"><spine><asset-clip name="x{m}" ref="a1" offset="0s" duration="6/25s" start="{m}/25s"/>'
        title = f'<title name="z{m}" ref="e1" lane="1" offset="{12 if m == 3 else 2}/25s" duration="9/25s"/>'
        last = x("ref-clip", F.concat(volume(F.lit(-1)), ramp(8, 1 + m), F.lit(title)), name=f"y{m}", ref=f"m{m + 1}", offset=6, duration=8) if m < 3 else x("asset-clip", F.concat(volume(F.lit(-1)), F.lit(title.replace("12/25s", "2/25s"))), name="y3", ref="a2", offset=6, duration=8, start=10)
        inner.append(F.concat(F.lit(head), last, F.lit("</spine></sequence></media>")))
    loop = '<media id="m4"><sequence duration="100s"><spine><asset-clip name="c" ref="a2" offset="0s" duration="3/25s"/><ref-clip name="l" ref="m4" offset="3/25s" duration="5/25s"/></spine></sequence></media>'
    cams = '<media id="mc"><multicam><mc-angle angleID="g0"><asset-clip name="p" ref="a1" offset="0s" duration="30/25s" start="2/25s"/></mc-angle><mc-angle angleID="g1"><gap offset="0s" duration="5/25s"/><asset-clip name="q" ref="a2" offset="5/25s" duration="25/25s"/></mc-angle></multicam></media>'
    assets = '<format id="r1" frameDuration="1/25s"/><effect id="e1" uid="t"/><asset id="a1" start="0s" duration="100s" hasAudio="1"/><asset id="a2" start="10/25s" duration="13/25s" hasAudio="1"/>'
    text = F.concat(F.lit("<fcpxml><resources>" + assets), *inner, F.lit(loop + cams + '</resources><project uid="p"><sequence format="r1" duration="'), t(F.col("whole")), F.lit('"><spine>'), "clips", F.lit("</spine></sequence></project></fcpxml>"))
    where = folder(spark, "timelines")
    docs.select("doc", text.alias("value")).repartition("doc").write.partitionBy("doc").text(where)
    return N.read_nodes(spark, where).withColumn("doc", F.regexp_extract("doc", r"doc=([0-9]+)/", 1).cast("int"))


@query(f"""WITH RECURSIVE {ITEMS}, {WALK},
told AS (SELECT *, i0 - CASE ref WHEN 'a2' THEN {10 * TICK} ELSE 0 END AS src, (e - b) * num * snum // (den * sden) AS src_len FROM seen WHERE is_on AND own_on AND (tag = 'asset' OR loops)),
ruled AS (SELECT *, CASE WHEN loops THEN 'cycle' WHEN ramp < 0 THEN 'reverse' WHEN role = 'music' THEN 'role' WHEN src < 0 OR (ref = 'a2' AND src + src_len > {13 * TICK} + 25 * {TICK} // 48000) THEN 'range' END AS reason FROM told)
SELECT doc, path, ref AS asset, {shown('b')} AS "offset", {shown('e - b')} AS duration, CASE WHEN reason IS NULL THEN {shown('src')} END AS source, CASE WHEN reason IS NULL THEN {shown('src_len')} END AS source_len,
       (b * 1280 + {TICK}) // {2 * TICK} AS start_sample, (e * 1280 + {TICK}) // {2 * TICK} - (b * 1280 + {TICK}) // {2 * TICK} AS samples, (db + own_db)::DOUBLE AS db, role, reason FROM ruled""")
def src1_rec1_join3_join4_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of sound in project time, from project files through nested media, maps, angles and lanes; what cannot be followed with its reason."""
    return P.plan(P.walked(written_timelines(spark, sf_dir))).withColumn("db", F.col("db").cast("double"))


@query(f"""WITH RECURSIVE {ITEMS}, {WALK},
hull AS (SELECT doc, path, min(b) AS b, max(e) AS e, count(*)::INTEGER AS pieces, bool_or(warped) AS warped FROM seen WHERE tag = 'title' GROUP BY ALL)
SELECT doc, path, {shown('b')} AS "begin", {shown('e')} AS "end", pieces, warped, true AS enabled, (b // {TICK})::BIGINT AS start_frame, ((e + {TICK - 1}) // {TICK})::BIGINT AS end_frame, b % {TICK} = 0 AND e % {TICK} = 0 AS exact FROM hull""")
def rec2_win13_title_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is seen of each title, through all the maps above it: hull, pieces, and the frames that cover it."""
    nodes = written_timelines(spark, sf_dir)
    return P.titles(P.walked(nodes), N.header(nodes))
