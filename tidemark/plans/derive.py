"""Timed data derived from the driver's tables, the same in Spark and in SQL.

Integers only (milliseconds, microseconds, frames, hundredths), so that both engines agree to the digit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by(*keys: str) -> Window:
    return Window.partitionBy(*keys)


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, pos, text, start_ms, end_ms: conversations as timed words; a pause follows a stop or a comma."""
    turns = table(spark, sf_dir, "conversations")
    split = turns.select(F.col("conv_id").alias("doc"), "turn", F.posexplode(F.filter(F.split("text", " "), lambda x: x != "")).alias("p", "text"))
    numbered = split.withColumn("pos", F.row_number().over(by("doc").orderBy("turn", "p")))
    last = F.substring("text", -1, 1)
    timed = numbered.withColumn("dur", 80 + 20 * F.char_length("text")).withColumn("gap", F.when(last.isin(".", "?", "!"), 700).when(last == ",", 150).otherwise(0))
    end = F.sum(F.col("dur") + F.col("gap")).over(by("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)) - F.col("gap")
    return timed.withColumn("end_ms", end).select("doc", F.col("pos").cast("long").alias("pos"), "text", (F.col("end_ms") - F.col("dur")).alias("start_ms"), "end_ms")


WORDS = """
w0 AS (SELECT conv_id AS doc, turn, unnest(list_filter(string_split(text, ' '), lambda x: x <> '')) AS text, generate_subscripts(list_filter(string_split(text, ' '), lambda x: x <> ''), 1) AS p FROM conversations),
w1 AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY turn, p) AS pos, text, 80 + 20 * length(text) AS dur,
       CASE WHEN right(text, 1) IN ('.', '?', '!') THEN 700 WHEN right(text, 1) = ',' THEN 150 ELSE 0 END AS gap FROM w0),
word AS (SELECT doc, pos, text, (e - dur)::BIGINT AS start_ms, e::BIGINT AS end_ms FROM (SELECT *, sum(dur + gap) OVER (PARTITION BY doc ORDER BY pos) - gap AS e FROM w1))
"""


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, b, e (microseconds), k, by user: events as intervals of `value` seconds; k numbers the event types."""
    ev = table(spark, sf_dir, "events")
    b = F.unix_micros(F.col("ts").cast("timestamp"))
    return ev.select(F.col("user_id").alias("u"), F.col("event_id").alias("id"), b.alias("b"), (b + F.round(F.col("value") * 1000).cast("long") * 1000).alias("e"), "event_type")


INTERVALS = """
iv AS (SELECT user_id AS u, event_id AS id, epoch_us(ts) AS b, epoch_us(ts) + round(value * 1000)::BIGINT * 1000 AS e, event_type FROM events)
"""


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, ord, asset, effect, off, len, role, flags: an order is a container, its lines are contiguous clips."""
    li = table(spark, sf_dir, "lineitem")
    # Line numbers repeat within an order here: the other columns break ties.
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]
    li = li.withColumn("ord", F.row_number().over(by("l_orderkey").orderBy(*order)).cast("long")).withColumn("len", F.col("l_quantity").cast("long"))
    off = F.sum("len").over(by("l_orderkey").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    role = F.concat(F.when(F.col("l_returnflag") == "R", "music").when(F.col("l_returnflag") == "A", "dialogue").otherwise("effects"), F.lit("."), F.lower("l_linestatus"))
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    return li.select(F.col("l_orderkey").alias("doc"), "ord", F.col("l_partkey").alias("asset"), F.col("l_suppkey").alias("effect"), F.coalesce(off, F.lit(0)).cast("long").alias("off"), "len", role.alias("role"), cents("l_discount").alias("disc"), cents("l_tax").alias("tax"))


CLIPS = """
li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) AS ord FROM lineitem),
clip AS (SELECT l_orderkey AS doc, ord, l_partkey AS asset, l_suppkey AS effect,
    coalesce(sum(l_quantity::BIGINT) OVER (PARTITION BY l_orderkey ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off, l_quantity::BIGINT AS len,
    CASE l_returnflag WHEN 'R' THEN 'music' WHEN 'A' THEN 'dialogue' ELSE 'effects' END || '.' || lower(l_linestatus) AS role,
    round(l_discount * 100)::BIGINT AS disc, round(l_tax * 100)::BIGINT AS tax FROM li)
"""


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stream, i, x: samples in hundredths; a stream for every 2,048 order numbers, so there are more of them where there is more data."""
    c = clips(spark, sf_dir)
    stream = F.floor(F.col("doc") / 2048).cast("long")
    return c.select(stream.alias("stream"), (F.row_number().over(Window.partitionBy(stream).orderBy("doc", "ord")) - 1).cast("long").alias("i"), (F.col("disc") - 5).alias("x"))


SIGNAL = CLIPS + """,
sig AS (SELECT doc // 2048 AS stream, row_number() OVER (PARTITION BY doc // 2048 ORDER BY doc, ord) - 1 AS i, disc - 5 AS x FROM clip)
"""
