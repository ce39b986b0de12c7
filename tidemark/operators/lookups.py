"""Look-ups and matches: dimension joins, longest prefixes, inverted indexes, as-of interpolation, set logic, picks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_of(rows: DataFrame, key: str, order: str) -> DataFrame:
    """D2: the row with the greatest order of each key; a map-side maximum, no sort."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(key, *[F.col("_r")[c].alias(c) for c in rest])


def looked_up(facts: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """JOIN1: N:1 look-up; `found` says whether there was a row. Which side is sent is left to the sizes that Spark sees at run time."""
    return facts.join(dimension.withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def longest_prefix(rows: DataFrame, settings: DataFrame, name: str = "name", role: str = "role") -> DataFrame:
    """JOIN5: the most specific setting whose role equals the name or leads it up to a dot.

    Names are far fewer than rows: each distinct name is resolved once, its few dotted prefixes joined by equality, and the rows look their
    name up. No theta join, and nothing is numbered."""
    names = rows.select(name).distinct()
    parts = F.split(name, r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))
    given = [c for c in settings.columns if c != role]
    hit = names.withColumn("_p", F.explode(prefixes)).join(settings.withColumnRenamed(role, "_p"), "_p")
    best = hit.groupBy(name).agg(F.max_by(F.struct(*given, F.col("_p").alias("setting")), F.length("_p")).alias("_b"))
    return rows.join(best, name, "left").select(*rows.columns, *[F.col("_b")[c].alias(c) for c in given], F.col("_b.setting").alias("setting"))


def grams(tokens: DataFrame, keys: Sequence[str], pos: str, word: str) -> DataFrame:
    """Three words in a row with their place: keys, k1, k2, k3, at."""
    w = Window.partitionBy(*keys).orderBy(pos)
    g = tokens.select(*keys, F.col(pos).alias("at"), F.col(word).alias("k1"), F.lead(word, 1).over(w).alias("k2"), F.lead(word, 2).over(w).alias("k3"))
    return g.where("k3 IS NOT NULL")


def retrieved(query: DataFrame, index: DataFrame, most: int = 40) -> DataFrame:
    """JOIN12: places of query 3-grams in the index; grams with more than `most` places establish nothing and are left out."""
    usable = index.groupBy("k1", "k2", "k3").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= most).drop("n")
    return query.join(index.join(usable, ["k1", "k2", "k3"], "left_semi").withColumnRenamed("at", "at2"), ["k1", "k2", "k3"])


def voted(matches: DataFrame, keys: Sequence[str], top: int = 8) -> DataFrame:
    """AGG6, ORD4: offsets by votes, best first; ties go to the offset that was met first. Counted before any row is ranked."""
    votes = matches.groupBy(*keys, (F.col("at2") - F.col("at")).alias("off")).agg(F.count(F.lit(1)).alias("votes"), F.min(F.struct("at", "at2")).alias("met"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("votes"), "met"))
    return votes.withColumn("rank", rank).where(F.col("rank") <= top).drop("met")


def interpolated(points: DataFrame, keyframes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """JOIN16: value at t between the keyframes around it, held at both ends. keyframes: keys, at, value; points: keys, t."""
    # An as-of join as one ordered pass: keyframes and points in one order, each point after the last keyframe before it.
    w = Window.partitionBy(*keys).orderBy("at")
    frame = F.struct("at", "value", F.lead("at").over(w).alias("at2"), F.lead("value").over(w).alias("value2"))
    seg = keyframes.select(*keys, F.col("at").cast("double").alias("t"), F.lit(0).alias("_kind"), frame.alias("_f"))
    both = seg.unionByName(points.select(*keys, F.col("t").cast("double").alias("t"), F.lit(1).alias("_kind")), allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy("t", "_kind")
    last = F.coalesce(F.last("_f", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.min("_f").over(Window.partitionBy(*keys)))
    hit = both.withColumn("_last", last).where("_kind = 1 AND _last IS NOT NULL").select(*keys, "t", "_last.*")
    share = (F.col("t") - F.col("at")) / (F.col("at2") - F.col("at"))
    value = F.when((F.col("t") <= F.col("at")) | F.col("at2").isNull(), F.col("value").cast("double")).otherwise(F.col("value") + (F.col("value2") - F.col("value")) * share)
    return hit.select(*keys, "t", value.alias("value"))


def channel_overlap(outer: DataFrame, inner: DataFrame, keys: Sequence[str]) -> DataFrame:
    """JOIN14: channels in both layouts; a group's weight is shared by the channels it had before the cut, once."""
    group = outer.withColumn("share", F.col("gain") / F.size("channels")).withColumn("channel", F.explode("channels")).drop("channels", "gain")
    return group.join(inner.withColumn("channel", F.explode("channels")).drop("channels"), [*keys, "channel"])


def newest_valid(rows: DataFrame, keys: Sequence[str], valid: Column, order: str, value: str) -> DataFrame:
    """JOIN19, ORD8: the value of the newest valid row of each key."""
    return rows.where(valid).groupBy(*keys).agg(F.max_by(value, order).alias(value), F.max(order).alias(order))


def ranked(rows: DataFrame, order: Sequence[str], name: str = "rank") -> DataFrame:
    """ORD1: rows numbered from 1 in a total order. Ranges of the order are sorted apart; their offsets are running counts, one row for each range."""
    from tidemark.shared import stored

    dealt = stored(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    # One row for each range, whatever the rows: their running sum is one small sort.
    so_far = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_range", F.coalesce(F.sum("_n").over(so_far), F.lit(0)).alias("_offset"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.withColumn("_k", within).join(F.broadcast(offsets), "_range").select(*rows.columns, (F.col("_k") + F.col("_offset")).cast("long").alias(name))


def paired(files: DataFrame, key: str, path: str = "path") -> DataFrame:
    """SRC19: key, xml, audio of the exports that hold exactly one project and one sound file, by their suffixes."""
    kind = lambda suffixes: F.when(F.rlike(F.lower(path), F.lit(rf"\.({suffixes})$")), F.col(path))
    xml, audio = kind("fcpxml|xml"), kind("wav|aif|aiff|m4a|mp3|caf")
    found = files.groupBy(key).agg(F.max(xml).alias("xml"), F.max(audio).alias("audio"), F.count(xml).alias("_x"), F.count(audio).alias("_a"))
    return found.where("_x = 1 AND _a = 1").select(key, "xml", "audio")


def ordered_distinct(rows: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    """AGG8: distinct values of a key in order of first occurrence, as an array."""
    first = rows.groupBy(*keys, value).agg(F.min(order).alias("_o"))
    return first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", value))), lambda x: x[value]).alias("values"))
