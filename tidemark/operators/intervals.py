"""Interval operators: clipping, coverage, islands, tiling, overlap joins, piecewise maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clip(b: Column, e: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """FIL3: [b, e) inside [low, high); keep where the first is below the second."""
    return F.greatest(b, low), F.least(e, high)


def _so_far(keys: Sequence[str], order: Sequence[Column | str]) -> Window:
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def union_length(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """AGG4: length covered by any interval of a key; intervals that do not grow are counted as invalid."""
    bad = rows.where("e < b OR b IS NULL OR e IS NULL").groupBy(*keys).agg(F.count(F.lit(1)).alias("invalid"))
    before = F.max("e").over(_so_far(keys, ["b", "e"]))
    grown = rows.where("e >= b").withColumn("_n", F.greatest(F.lit(0), F.col("e") - F.greatest(F.col("b"), F.coalesce(before, F.col("b")))))
    good = grown.groupBy(*keys).agg(F.sum("_n").alias("covered"))
    return good.join(bad, list(keys), "full_outer").select(*keys, F.coalesce("covered", F.lit(0)).alias("covered"), F.coalesce("invalid", F.lit(0)).alias("invalid"))


def merged(rows: DataFrame, keys: Sequence[str], order: Sequence[str] = ("b", "e", "id")) -> DataFrame:
    """WIN5: islands of overlapping intervals, by the running end; touching ones stay apart. Texts, if there are, are put together in order."""
    before = F.max("e").over(_so_far(keys, order))
    marked = rows.withColumn("_new", F.when(F.col("b") < before, 0).otherwise(1))
    island = F.sum("_new").over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    said = []
    if "text" in rows.columns:
        said = [F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "text"))), lambda r: r["text"]), "").alias("text")]
    return marked.withColumn("island", island.cast("long")).groupBy(*keys, "island").agg(F.min("b").alias("b"), F.max("e").alias("e"), F.count(F.lit(1)).alias("n"), *said)


def tiled(rows: DataFrame, total: DataFrame, key: str = "doc", order: str = "caption_no") -> DataFrame:
    """WIN16: gap rows before, between and after the titles of a key, so that they tile [0, total)."""
    before = F.coalesce(F.lag("b").over(Window.partitionBy(key).orderBy(order)), F.lit(0))
    gaps = rows.withColumn("_p", before).where(F.col("a") > F.col("_p")).select(key, F.col("_p").alias("a"), F.col("a").alias("b"), F.lit("gap").alias("kind"))
    tail = rows.groupBy(key).agg(F.max("b").alias("a")).join(total, key).where(F.col("a") < F.col("total")).select(key, "a", F.col("total").alias("b"), F.lit("gap").alias("kind"))
    return rows.select(key, "a", "b", F.lit("title").alias("kind")).unionByName(gaps).unionByName(tail)


def broken_tiles(rows: DataFrame, keys: Sequence[str], order: str = "ord") -> DataFrame:
    """WIN17: rows that do not begin where the one before ends (the first: at 0)."""
    expected = F.coalesce(F.sum("len").over(_so_far(keys, [order])), F.lit(0))
    return rows.withColumn("expected", expected).where(F.col("off") != F.col("expected"))


def overlaps(left: DataFrame, right: DataFrame, keys: Sequence[str], width: int | None = None) -> DataFrame:
    """JOIN6/9: pairs with left.b < right.e2 and right.b2 < left.e, for equal keys.

    With `width`, both sides are dealt into time buckets first, so that one busy key is spread over its
    time; a pair is kept in the bucket where its intersection begins, so none comes twice.
    """
    meet = (F.col("b") < F.col("e2")) & (F.col("b2") < F.col("e"))
    if width is None:
        return left.join(right, list(keys)).where(meet)
    buckets = lambda b, e: F.sequence(F.floor(F.col(b) / width), F.floor(F.greatest(F.col(b), F.col(e) - 1) / width))
    one, two = left.withColumn("_t", F.explode(buckets("b", "e"))), right.withColumn("_t", F.explode(buckets("b2", "e2")))
    first = F.floor(F.greatest(F.col("b"), F.col("b2")) / width)
    return one.join(two, [*keys, "_t"]).where(meet & (F.col("_t") == first)).drop("_t")


def collision(rows: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """JOIN8: exact matches (enabled, exactly timed, same text and times) and overlapping rows of each key, with the verdict."""
    exact = existing.where("enabled AND exact").select(*keys, "b", "e", "text").distinct()
    same = rows.join(exact, [*keys, "b", "e", "text"], "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("exact_matches"))
    spans = existing.select(*keys, F.col("b").alias("b2"), F.col("e").alias("e2"))
    hit = overlaps(rows.select(*keys, "id", "b", "e"), spans, keys, 600_000_000).select(*keys, "id").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("overlapping"))
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    m = existing.groupBy(*keys).agg(F.count(F.lit(1)).alias("existing"))
    out = n.join(m, list(keys), "left").join(same, list(keys), "left").join(hit, list(keys), "left").na.fill(0, ["existing", "exact_matches", "overlapping"])
    status = F.when((F.col("exact_matches") == F.col("n")) & (F.col("n") == F.col("existing")), "duplicate").when(F.col("overlapping") > 0, "conflict").otherwise("clear")
    return out.select(*keys, status.alias("status"), "exact_matches", "overlapping", "existing")


def point_in_interval(points: DataFrame, rows: DataFrame, keys: Sequence[str], order: str = "ord", width: int = 64) -> DataFrame:
    """JOIN15: for each instant the first interval (by order) that holds it. Both sides are dealt into time buckets of `width`, so a busy key is
    spread over its time and an instant meets the intervals of its bucket alone."""
    dealt = rows.where("b < e").withColumn("_t", F.explode(F.sequence(F.floor(F.col("b") / width), F.floor((F.col("e") - 1) / width))))
    hit = points.withColumn("_t", F.floor(F.col("t") / width)).join(dealt, [*keys, "_t"]).where((F.col("t") >= F.col("b")) & (F.col("t") < F.col("e")))
    return hit.groupBy(*keys, "t").agg(F.min_by("id", order).alias("id"))


def piecewise(points: DataFrame, keys: Sequence[str], order: str = "out") -> DataFrame:
    """WIN13: consecutive (out, src) points as segments; a segment that does not move in the source is a freeze, one that runs back is refused."""
    w = Window.partitionBy(*keys).orderBy(order)
    seg = points.withColumn("out_end", F.lead("out").over(w)).withColumn("src_end", F.lead("src").over(w)).where("out_end IS NOT NULL")
    reason = F.when(F.col("src_end") < F.col("src"), "reverse").when(F.col("src_end") == F.col("src"), "freeze").otherwise("play")
    return seg.withColumn("reason", reason)


def inverse_ranges(ranges: DataFrame, segments: DataFrame, keys: Sequence[str], width: int = 64) -> DataFrame:
    """JOIN6, JOIN7: source ranges through the playing segments of a time map, clipped; numerators over the segment's source length, so exact.

    Other columns of the ranges go along. A gain clock (scale, shift: gain time = scale * source + shift) is taken to the output:
    source = src + (out' - out) den / span, so its scale and shift are numerators over `span`, the segment's output length.
    Both sides are dealt into buckets of source time."""
    playing = segments.where("reason = 'play'").withColumnRenamed("src", "b2").withColumnRenamed("src_end", "e2")
    carried = [c for c in ranges.columns if c not in (*keys, "id", "b", "e", "scale", "shift")]
    hit = overlaps(ranges, playing, keys, width).withColumnRenamed("b2", "src").withColumnRenamed("e2", "src_end")
    low, high = F.greatest("b", "src"), F.least("e", "src_end")
    den = F.col("src_end") - F.col("src")
    at = lambda x: F.col("out") * den + (x - F.col("src")) * (F.col("out_end") - F.col("out"))
    span = F.col("out_end") - F.col("out")
    clock = []
    if {"scale", "shift"} <= set(ranges.columns):
        clock = [(F.col("scale") * den).alias("scale_num"), ((F.col("scale") * F.col("src") + F.col("shift")) * span - F.col("scale") * F.col("out") * den).alias("shift_num"), span.alias("span")]
    return hit.select(*keys, "id", "out", at(low).alias("from_num"), at(high).alias("to_num"), den.alias("den"), *carried, *clock)
