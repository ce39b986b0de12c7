"""Queries over intervals and contiguous clips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import intervals as I  # noqa: E741
from tidemark.plans.derive import CLIPS, INTERVALS, clips, intervals, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):  # noqa: ANN201
    def register(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


DAY = 86_400_000_000


@query(f"WITH {INTERVALS}, c AS (SELECT u, id, greatest(b, b // 3600000000 * 3600000000 + 600000000) AS b, least(e, b // 3600000000 * 3600000000 + 2400000000) AS e FROM iv) SELECT * FROM c WHERE b < e")
def fil3_interval_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    iv = intervals(spark, sf_dir)
    hour = F.col("b") - F.pmod("b", F.lit(3_600_000_000))
    b, e = I.clip(F.col("b"), F.col("e"), hour + 600_000_000, hour + 2_400_000_000)
    return iv.select("u", "id", b.alias("b"), e.alias("e")).where("b < e")


@query(f"""WITH {INTERVALS}, g AS (SELECT *, max(e) OVER (PARTITION BY u ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM iv WHERE e >= b)
SELECT u, sum(greatest(0, e - greatest(b, coalesce(p, b))))::BIGINT AS covered, 0::BIGINT AS invalid FROM g GROUP BY u""")
def agg4_union_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.union_length(intervals(spark, sf_dir), ["u"])


@query(f"""WITH {INTERVALS}, g AS (SELECT *, CASE WHEN b < max(e) OVER (PARTITION BY u ORDER BY b, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM iv),
h AS (SELECT *, sum(new) OVER (PARTITION BY u ORDER BY b, e, id)::BIGINT AS island FROM g) SELECT u, island, min(b) AS b, max(e) AS e, count(*) AS n, string_agg(event_type, '' ORDER BY b, e, id) AS text FROM h GROUP BY u, island""")
def win5_merge_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.merged(intervals(spark, sf_dir).withColumnRenamed("event_type", "text"), ["u"])


@query(f"WITH {INTERVALS} SELECT u, id FROM (SELECT *, lag(e) OVER (PARTITION BY u ORDER BY b, id) AS p FROM iv) WHERE b < p")
def win2_out_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.operators.sessions import out_of_order

    return out_of_order(intervals(spark, sf_dir), ["u"], ["b", "id"], "b", "e").select("u", "id")


@query(f"WITH {CLIPS}, d AS (SELECT doc, ord, off, off + CASE WHEN doc % 11 = 0 AND ord = 2 THEN 1 ELSE 0 END AS moved, len FROM clip) SELECT doc, ord, moved - off AS by FROM d WHERE moved <> off")
def win17_broken_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.col("off") + F.when((F.pmod("doc", F.lit(11)) == 0) & (F.col("ord") == 2), 1).otherwise(0)
    return I.broken_tiles(clips(spark, sf_dir).withColumn("off", moved), ["doc"]).select("doc", "ord", (F.col("off") - F.col("expected")).alias("by"))


@query(f"WITH {INTERVALS} SELECT a.u, a.id, c.id AS id2, greatest(a.b, c.b) AS b, least(a.e, c.e) AS e FROM iv a JOIN iv c ON a.u = c.u AND a.b < c.e AND c.b < a.e AND a.id < c.id")
def join9_span_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    iv = intervals(spark, sf_dir)
    right = iv.select("u", F.col("id").alias("id2"), F.col("b").alias("b2"), F.col("e").alias("e2"))
    hit = I.overlaps(iv.select("u", "id", "b", "e"), right, ["u"], 600_000_000)
    return hit.where("id < id2").select("u", "id", "id2", F.greatest("b", "b2").alias("b"), F.least("e", "e2").alias("e"))


@query(f"WITH {INTERVALS} SELECT u, id FROM iv a WHERE NOT EXISTS (SELECT 1 FROM iv c WHERE c.id <> a.id AND a.u = c.u AND a.b < c.e AND c.b < a.e)")
def join10_span_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    iv = intervals(spark, sf_dir)
    right = iv.select("u", F.col("id").alias("id2"), F.col("b").alias("b2"), F.col("e").alias("e2"))
    left = iv.select("u", "id", "b", "e")
    hit = I.overlaps(left, right, ["u"], 600_000_000).where("id <> id2").select("u", "id").distinct()
    return left.join(hit, ["u", "id"], "left_anti").select("u", "id")


@query(f"""WITH {INTERVALS}, r AS (SELECT *, event_type AS text FROM iv), x AS (SELECT u, b, CASE WHEN id % 3 = 0 THEN e + 1 ELSE e END AS e, event_type AS text, id % 5 <> 0 AS enabled, id % 7 <> 0 AS exact FROM iv WHERE event_type <> 'click'),
n AS (SELECT u, count(*) AS n FROM r GROUP BY u), m AS (SELECT u, count(*) AS existing FROM x GROUP BY u),
s AS (SELECT u, count(*) AS k FROM r WHERE EXISTS (SELECT 1 FROM x WHERE x.u = r.u AND x.b = r.b AND x.e = r.e AND x.text = r.text AND enabled AND exact) GROUP BY u),
h AS (SELECT u, count(*) AS k FROM r WHERE EXISTS (SELECT 1 FROM x WHERE x.u = r.u AND r.b < x.e AND x.b < r.e) GROUP BY u)
SELECT n.u, CASE WHEN coalesce(s.k, 0) = n AND n = coalesce(existing, 0) THEN 'duplicate' WHEN coalesce(h.k, 0) > 0 THEN 'conflict' ELSE 'clear' END AS status, coalesce(s.k, 0) AS exact_matches, coalesce(h.k, 0) AS overlapping, coalesce(existing, 0) AS existing
FROM n LEFT JOIN m USING (u) LEFT JOIN s USING (u) LEFT JOIN h USING (u)""")
def join8_collision(spark: SparkSession, sf_dir: str) -> DataFrame:
    iv = intervals(spark, sf_dir).withColumnRenamed("event_type", "text")
    old = iv.where("text <> 'click'").select("u", "b", F.when(F.col("id") % 3 == 0, F.col("e") + 1).otherwise(F.col("e")).alias("e"), "text", (F.col("id") % 5 != 0).alias("enabled"), (F.col("id") % 7 != 0).alias("exact"))
    return I.collision(iv, old, ["u"])


POINTS = "pt AS (SELECT DISTINCT l_orderkey AS doc, (l_linenumber * 13 % 60)::BIGINT AS t FROM lineitem)"


@query(f"WITH {CLIPS}, {POINTS} SELECT doc, t, arg_min(asset, ord) AS id FROM pt JOIN clip USING (doc) WHERE t >= off AND t < off + len GROUP BY doc, t")
def join15_point_in_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), (F.col("l_linenumber") * 13 % 60).cast("long").alias("t")).distinct()
    rows = clips(spark, sf_dir).select("doc", "ord", F.col("asset").alias("id"), F.col("off").alias("b"), (F.col("off") + F.col("len")).alias("e"))
    return I.point_in_interval(points, rows, ["doc"])


MAP = CLIPS + ", pts AS (SELECT doc, off AS out, off * 2 + CASE WHEN disc = 0 THEN -4 WHEN disc = 1 THEN 5 ELSE disc END AS src FROM clip), seg AS (SELECT *, CASE WHEN src_end < src THEN 'reverse' WHEN src_end = src THEN 'freeze' ELSE 'play' END AS reason FROM (SELECT *, lead(out) OVER (PARTITION BY doc ORDER BY out) AS out_end, lead(src) OVER (PARTITION BY doc ORDER BY out) AS src_end FROM pts) WHERE out_end IS NOT NULL)"


def within_a_frame(a: Column, b: Column, num: Column, den: Column, unit: int = 1200, rate: int = 16000) -> Column:
    """FIL21: whether lengths a and b, in units of 1 / `unit` s, differ by at most the longer of a frame (den / num s) and a sample."""
    return F.abs(a - b) * num.cast("long") * rate <= F.greatest(F.lit(unit).cast("long") * den * rate, F.lit(unit).cast("long") * num)


def time_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = F.col("off") * 2 + F.when(F.col("disc") == 0, -4).when(F.col("disc") == 1, 5).otherwise(F.col("disc"))
    return I.piecewise(clips(spark, sf_dir).select("doc", F.col("off").alias("out"), src.alias("src")), ["doc"])


@query(f"WITH {MAP} SELECT * FROM seg")
def win13_piecewise_time_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return time_map(spark, sf_dir)


@query(f"WITH {MAP}, rg AS (SELECT doc, ord AS id, off * 2 + 3 AS b, off * 2 + len + 3 AS e, role, tax AS scale, disc AS shift FROM clip) SELECT doc, id, role, scale * (src_end - src) AS scale_num, (scale * src + shift) * (out_end - out) - scale * out * (src_end - src) AS shift_num, out_end - out AS span, out, out * (src_end - src) + (greatest(b, src) - src) * (out_end - out) AS from_num, out * (src_end - src) + (least(e, src_end) - src) * (out_end - out) AS to_num, src_end - src AS den FROM rg JOIN seg USING (doc) WHERE reason = 'play' AND b < src_end AND src < e")
def join6_join7_inverse_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = clips(spark, sf_dir).select("doc", F.col("ord").alias("id"), (F.col("off") * 2 + 3).alias("b"), (F.col("off") * 2 + F.col("len") + 3).alias("e"), "role", F.col("tax").alias("scale"), F.col("disc").alias("shift"))
    return I.inverse_ranges(ranges, time_map(spark, sf_dir), ["doc"])


@query(f"WITH {CLIPS} SELECT doc, max(off + len + tax) AS end, min(off - disc) AS low, max(off + len + tax) = sum(len) AS whole FROM clip WHERE asset % 3 <> 0 GROUP BY doc")
def agg11_agg12_hull(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hull of what is heard, with handles on both sides; whole where it ends just where all clips that are heard would, one after the other."""
    end = F.col("off") + F.col("len") + F.col("tax")
    return clips(spark, sf_dir).where("asset % 3 <> 0").groupBy("doc").agg(F.max(end).alias("end"), F.min(F.col("off") - F.col("disc")).alias("low"), (F.max(end) == F.sum("len")).alias("whole"))


@query(f"WITH {CLIPS} SELECT doc, ord, 'gap-' || reason AS kind FROM (SELECT *, CASE WHEN len * 40 < 160 THEN 'short' WHEN split_part(role, '.', 1) = 'music' THEN 'role' END AS reason FROM clip) WHERE reason IS NOT NULL AND len >= 1")
def fil11_skipped_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.when(F.col("len") * 40 < 160, "short").when(F.split_part("role", F.lit("."), F.lit(1)) == "music", "role")
    return clips(spark, sf_dir).where(reason.isNotNull() & (F.col("len") >= 1)).select("doc", "ord", F.concat(F.lit("gap-"), reason).alias("kind"))


@query(f"WITH {CLIPS}, p AS (SELECT doc, 'picture' AS kind, ord, off, len FROM clip UNION ALL SELECT doc, 'audio', ord, greatest(0, off - disc), len + least(off, disc) + tax FROM clip) SELECT * FROM p")
def fil18_split_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    picture = F.struct(F.lit("picture").alias("kind"), F.col("off"), F.col("len"))
    audio = F.struct(F.lit("audio").alias("kind"), F.greatest(F.lit(0), F.col("off") - F.col("disc")).cast("long").alias("off"), (F.col("len") + F.least("off", "disc") + F.col("tax")).alias("len"))
    both = clips(spark, sf_dir).select("doc", "ord", F.explode(F.array(picture, audio)).alias("x"))
    return both.select("doc", "x.kind", "ord", "x.off", "x.len")


@query(f"""WITH {CLIPS}, n AS (SELECT *, lag(len) OVER w AS before, lead(len) OVER w AS after FROM clip WINDOW w AS (PARTITION BY doc ORDER BY ord))
SELECT doc, ord, CASE WHEN before IS NULL OR after IS NULL THEN CASE WHEN disc <= len THEN 'edge' ELSE 'refused' END WHEN disc <= 8 AND disc <= 2 * before AND disc <= 2 * after THEN 'straddles' ELSE 'refused' END AS verdict FROM n WHERE disc > 0""")
def win15_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("doc").orderBy("ord")
    n = clips(spark, sf_dir).withColumn("before", F.lag("len").over(w)).withColumn("after", F.lead("len").over(w)).where("disc > 0")
    edge = F.col("before").isNull() | F.col("after").isNull()
    inside = (F.col("disc") <= 8) & (F.col("disc") <= 2 * F.col("before")) & (F.col("disc") <= 2 * F.col("after"))
    verdict = F.when(edge, F.when(F.col("disc") <= F.col("len"), "edge").otherwise("refused")).when(inside, "straddles").otherwise("refused")
    return n.select("doc", "ord", verdict.alias("verdict"))


@query(f"WITH {CLIPS} SELECT doc, ord, CASE WHEN over > 0 AND over * 16 <= 16 THEN asset_len ELSE take END AS take, over > 1 AS refused FROM (SELECT doc, ord, len + disc % 5 AS take, len + 1 AS asset_len, len + disc % 5 - (len + 1) AS over FROM clip)")
def tim7_overshoot_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    take, have = F.col("len") + F.col("disc") % 5, F.col("len") + 1
    over = take - have
    return clips(spark, sf_dir).select("doc", "ord", F.when((over > 0) & (over <= 1), have).otherwise(take).alias("take"), (over > 1).alias("refused"))


@query(f"""WITH {CLIPS}, d AS (SELECT doc, sum(len) AS n, sum(disc) AS told, CASE doc % 3 WHEN 0 THEN 24000 WHEN 1 THEN 25000 ELSE 30000 END::BIGINT AS num, CASE doc % 3 WHEN 1 THEN 1000 ELSE 1001 END::BIGINT AS den FROM clip GROUP BY doc)
SELECT doc, abs(told * 5 - n) * num * 16000 <= greatest(1200 * den * 16000, 1200 * num) AS ok FROM d""")
def fil21_duration_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sound's length (frames of 1/1200 s) against the project's: apart by at most a frame of its own rate, or a sample, in whole numbers."""
    rate = F.pmod("doc", F.lit(3))
    d = clips(spark, sf_dir).groupBy("doc").agg(F.sum("len").alias("n"), F.sum("disc").alias("told"))
    num, den = F.when(rate == 0, 24000).when(rate == 1, 25000).otherwise(30000), F.when(rate == 1, 1000).otherwise(1001)
    return d.select("doc", within_a_frame(F.col("told") * 5, F.col("n"), num, den).alias("ok"))


@query(f"""WITH RECURSIVE {INTERVALS}, n AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY b, e - b DESC, id) AS k FROM iv),
g(u, k, id, b, stop, ok) AS (SELECT u, k, id, b, e, true FROM n WHERE k = 1 UNION ALL SELECT n.u, n.k, n.id, n.b, CASE WHEN n.b >= g.stop THEN n.e ELSE g.stop END, n.b >= g.stop FROM g JOIN n ON n.u = g.u AND n.k = g.k + 1)
SELECT u, id FROM g WHERE ok""")
def ord2_greedy_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.operators.folds import greedy

    return greedy(intervals(spark, sf_dir).select("u", "id", "b", "e"), ["u"]).select("u", "id")
