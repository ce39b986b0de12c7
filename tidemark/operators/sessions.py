"""Operators over ordered tokens: pauses, sessions, bridging, running clamps, runs of equal text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T


def ordered(keys: Sequence[str], order: Sequence[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def sessions(tokens: DataFrame, keys: Sequence[str], order: Sequence[str], new: Column, name: str = "block") -> DataFrame:
    """WIN3: number the sessions of each key; `new` says where one begins (NULL: it does not). Numbers start at 0."""
    w = ordered(keys, order)
    return tokens.withColumn(name, F.sum(F.when(new, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))


def pause_before(keys: Sequence[str], order: Sequence[str], start: str = "start_ms", end: str = "end_ms") -> Column:
    return F.col(start) - F.lag(end).over(ordered(keys, order))


def joined_text(tokens: DataFrame, keys: Sequence[str], order: Sequence[str], text: str = "text") -> DataFrame:
    """AGG15: tokens of a group in one text, with a space only between ASCII letters or digits; start and end of the group."""
    w = ordered(keys, order)
    before = F.lag(text).over(w)
    spaced = tokens.withColumn("_piece", F.concat(F.when(T.needs_space(before, F.col(text)), " ").otherwise(""), F.col(text)))
    numbered = spaced.withColumn("_n", F.row_number().over(w))
    parts = F.array_sort(F.collect_list(F.struct("_n", "_piece")))
    return numbered.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x["_piece"]), "").alias("text"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))


def bridged(rows: DataFrame, keys: Sequence[str], order: Sequence[str], most: int = 200) -> DataFrame:
    """WIN1: an end moves to the next start across a gap of 1 to `most`."""
    gap = F.lead("start_ms").over(ordered(keys, order)) - F.col("end_ms")
    return rows.withColumn("end_ms", F.when((gap > 0) & (gap <= most), F.col("end_ms") + gap).otherwise(F.col("end_ms")))


def out_of_order(rows: DataFrame, keys: Sequence[str], order: Sequence[str], start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """WIN2: rows that begin before the one before them has ended."""
    return rows.withColumn("_prev", F.lag(end).over(ordered(keys, order))).where(F.col(start) < F.col("_prev")).drop("_prev")


def clamped(rows: DataFrame, keys: Sequence[str], order: Sequence[str], unit: int = 50) -> DataFrame:
    """WIN7: times rounded to `unit`, starts no earlier than the end before; ok says that the row still has a length."""
    nearest = lambda c: (F.floor((F.col(c) * 2 + unit) / (2 * unit)) * unit).cast("long")
    r = rows.withColumn("_s", nearest("start_ms")).withColumn("_e", nearest("end_ms"))
    start = F.greatest(F.col("_s"), F.coalesce(F.lag("_e").over(ordered(keys, order)), F.lit(0)))
    return r.withColumn("start", start).withColumn("end", F.col("_e")).withColumn("ok", F.col("_e") > F.col("start")).drop("_s", "_e")


def char_offsets(tokens: DataFrame, keys: Sequence[str], order: Sequence[str], text: str = "text") -> DataFrame:
    """WIN14: each token's begin and end in the joined text."""
    w = ordered(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.char_length(text)).over(w)
    return tokens.withColumn("char_end", end.cast("long")).withColumn("char_start", F.col("char_end") - F.char_length(text))


def repeated_runs(chunks: DataFrame, keys: Sequence[str], order: Sequence[str], text: str, eligible: Column, least: int = 3) -> DataFrame:
    """WIN18: runs of `least` or more eligible neighbours with equal text: keys, first, last, n. Others break runs."""
    w = ordered(keys, order)
    same = F.col("_ok") & F.lag("_ok").over(w) & (F.col(text) == F.lag(text).over(w))
    marked = chunks.withColumn("_ok", F.coalesce(eligible, F.lit(False))).withColumn("_new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
    runs = marked.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.where("_ok").groupBy(*keys, "_run").agg(F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).drop("_run")


def context_windows(tokens: DataFrame, keys: Sequence[str], pos: str = "pos", step: int = 96, before: int = 12, after: int = 108) -> DataFrame:
    """WIN12: each token in every window [k*step - before, k*step + after) that holds it; pos counts from 0.

    The windows of a token follow from its place by arithmetic, so no join is needed."""
    first = F.greatest(F.lit(0), F.floor((F.col(pos) - after) / step) + 1).cast("long")
    last = F.floor((F.col(pos) + before) / step).cast("long")
    counted = tokens.withColumn("_n", F.max(pos).over(Window.partitionBy(*keys)))
    top = F.least(last, F.floor(F.col("_n") / step).cast("long"))
    return counted.withColumn("window", F.explode(F.filter(F.sequence(first, F.greatest(first, last)), lambda k: k <= top))).drop("_n")
