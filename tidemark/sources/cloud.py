"""STR17: results of a cloud recogniser: JSON with utterances of timed words, flattened and checked; timing is never invented."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T

RESULT = "result struct<text:string,utterances:array<struct<text:string,words:array<struct<text:string,start_time:double,end_time:double>>>>>"
#: Milliseconds that a time may lie beyond the end.
SLACK = 50


def results(rows: DataFrame, key: str, body: str, duration: str, offset: str, converted: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """key, utterance, n, text, start, end of each word of the results that hold, and key with a reason for the others.

    duration and offset are columns in seconds. `converted` turns text to simplified forms (identity where no library is given).
    Reasons: structure, words (an utterance says something without words), times (not finite, out of [0, duration], or running back),
    alignment (words say other than their utterance), text (utterances say other than the whole)."""
    r = rows.select(F.col(key).alias("k"), F.col(duration).alias("d"), F.col(offset).alias("o"), F.from_json(body, RESULT)["result"].alias("r"))
    said = r.select("k", "d", "o", F.posexplode("r.utterances").alias("u", "x"))
    word = said.select("k", "d", "o", "u", F.posexplode("x.words").alias("w", "y")).select("k", "d", "o", "u", "w", F.trim(converted(F.col("y.text"))).alias("text"), F.col("y.start_time").alias("s"), F.col("y.end_time").alias("e")).where("text <> '' OR text IS NULL")
    turn = Window.partitionBy("k").orderBy("u", "w")
    spoken = Window.partitionBy("k", "u").orderBy("w")
    space = F.when(T.needs_space(F.lag("text").over(spoken), F.col("text")), " ").otherwise("")
    sound = F.col("s").isNotNull() & F.col("e").isNotNull() & ~F.isnan("s") & ~F.isnan("e") & (F.col("s") >= 0) & (F.col("s") <= F.col("e")) & (F.col("e") <= F.col("d") * 1000 + SLACK)
    timed = word.withColumn("bad", ~F.coalesce(sound & (F.col("s") >= F.coalesce(F.lag("s").over(turn), F.lit(0.0))), F.lit(False))).withColumn("shown", F.concat(space, "text"))
    heard = timed.groupBy("k", "u").agg(F.array_sort(F.collect_list(F.struct("w", "text"))).alias("p"), F.max(F.col("bad") | F.col("text").isNull()).alias("bad"))
    same = lambda c: T.comparable(F.coalesce(c, F.lit("")))
    each = said.select("k", "u", converted(F.col("x.text")).alias("t"), (F.col("x.text").isNull() | F.col("x.words").isNull()).alias("broken")).join(heard, ["k", "u"], "left")
    words_of = same(F.array_join(F.coalesce(F.transform("p", lambda x: x["text"]), F.array().cast("array<string>")), ""))
    told = each.select("k", "u", "t", "broken", "bad", (F.col("p").isNull() & (same(F.col("t")) != "")).alias("mute"), (words_of != same(F.col("t"))).alias("apart"), F.col("p").isNotNull().alias("kept"))
    whole = told.groupBy("k").agg(F.max("broken").alias("broken"), F.max("mute").alias("mute"), F.max("bad").alias("bad"), F.max("apart").alias("apart"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kept"), F.struct("u", "t")))), lambda x: x["t"]), "").alias("all"))
    checked = r.join(whole, "k", "left")
    reason = F.when(F.col("r.utterances").isNull() | F.col("broken"), "structure").when(F.col("mute"), "words").when(F.col("bad"), "times").when(F.col("apart"), "alignment").when(F.col("r.text").isNotNull() & (same(converted(F.col("r.text"))) != same(F.col("all"))), "text")
    verdict = checked.select("k", reason.alias("reason"))
    at = lambda c: F.col("o") + F.least(F.col(c) / 1000, F.col("d"))
    good = timed.join(verdict.where("reason IS NULL"), "k").select("k", F.col("u").alias("utterance"), F.col("w").alias("n"), F.col("shown").alias("text"), at("s").alias("start"), at("e").alias("end"), "reason")
    return good.unionByName(verdict.where("reason IS NOT NULL"), allowMissingColumns=True).withColumnRenamed("k", key)
