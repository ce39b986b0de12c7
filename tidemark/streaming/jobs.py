"""Job queue semantics on Structured Streaming: directory polling, order contracts, claims, receipts, log tails.

Every stream here runs over files and to a sink in a folder, so a run can be stopped and taken up again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.shared import folder, stored  # noqa: F401


def polled(spark: SparkSession, path: str, schema, per_batch: int = 1) -> DataFrame:  # noqa: ANN001
    """SRC11, SRC13, STM1: new files in a directory, so many at a time, oldest first."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def run_to_files(stream: DataFrame, where: str, mode: str = "append") -> DataFrame:
    """Everything there is now, to Parquet; the sink's log makes each batch count once."""
    q = stream.writeStream.format("parquet").option("checkpointLocation", f"{where}/log").outputMode(mode).trigger(availableNow=True).start(f"{where}/rows")
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{where}/rows")


def thirds(rows: DataFrame, order: str) -> list[DataFrame]:
    """Rows in three parts by their order, so that a stream can be given one after the other."""
    low, high = rows.agg(F.percentile_approx(order, F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("c")).first()[0] or (0, 0)
    return [rows.where(F.col(order) <= low), rows.where((F.col(order) > low) & (F.col(order) <= high)), rows.where(F.col(order) > high)]


def ordered_runs(stream: DataFrame, key: str) -> DataFrame:
    """STM2, STM3: per key, each chunk (id, b, e, text) must not begin before the last one ended; equal texts in a row are counted.

    Rows out: id, ok, run. A chunk that breaks the order is an error row and leaves the state as it was.
    State is four values, whatever has been read; rows of a batch are taken by (b, id).
    """
    kinds = dict(stream.dtypes)

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        end, text, run = state.get if state.exists else (None, None, 0)
        out = []
        for r in pd.concat(list(frames)).sort_values(["b", "id"]).itertuples():
            ok = end is None or r.b >= end
            if ok:
                run = run + 1 if text is not None and r.text == text else 1
                end, text = int(r.e), r.text
            out.append((k[0], int(r.id), ok, run if ok else 0))
        state.update((end, text, run))
        yield pd.DataFrame(out, columns=[key, "id", "ok", "run"])

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, id long, ok boolean, run int", "last_end long, last_text string, run int", "append", GroupStateTimeout.NoTimeout)


def log_tail(lines: DataFrame, column: str, schema: str) -> DataFrame:
    """SRC12: JSON lines parsed, lines that are none ignored."""
    parsed = F.from_json(column, f"{schema}, _none string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_none"})
    return lines.withColumn("_j", parsed).where(F.col("_j").isNotNull() & F.col("_j._none").isNull()).withColumn("_j", F.col("_j").dropFields("_none")).select(*[c for c in lines.columns if c != column], "_j.*")


def once(stream: DataFrame, where: str, key: str, work: Callable[[DataFrame], DataFrame]) -> None:
    """STM5, STM6, SNK8: at most once. A batch's keys are claimed before the work begins and answered after it.

    A batch that comes again (after a stop between claim and answer) finds its keys claimed: they are
    answered as failed and never worked on a second time. Work on a key is idempotent per batch number.
    """
    spark = stream.sparkSession

    def have(path: str, like: DataFrame) -> DataFrame:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            return spark.read.schema(like.schema).parquet(path)
        return spark.createDataFrame([], like.schema)

    def batch(df: DataFrame, n: int) -> None:
        keys = df.select(key).distinct()
        claims = have(f"{where}/claims", keys)
        # Written, not cached: a cache that reads the claims would be made anew when the claims are written.
        fresh = stored(df.dropDuplicates([key]).join(claims, key, "left_anti"), "fresh")
        stale = stored(keys.join(claims, key, "left_semi"), "stale")
        answers = f"{where}/answers/batch={n}"
        if fresh.take(1):
            fresh.select(key).write.mode("append").parquet(f"{where}/claims")
            work(fresh).withColumn("status", F.lit("done")).select(key, "status").write.mode("overwrite").parquet(answers)
        elif stale.take(1):
            answered = have(f"{where}/answers", stale.withColumn("status", F.lit("")))
            lost = stale.join(answered.select(key), key, "left_anti")
            lost.withColumn("status", F.lit("failed")).write.mode("append").parquet(answers)

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{where}/log").trigger(availableNow=True).start().awaitTermination()


IDENTITY = ("uid", "model", "vocabulary")


def published(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """SNK8, SNK15, JOIN17: what is told about each request. Identity is compared again (NULL equals NULL), and a payload is shown only if
    it has the digest that was written with it: status pending, foreign, damaged or the response's own; payload or NULL."""
    answer = responses.select("id", *[F.col(c).alias(f"_{c}") for c in IDENTITY], "status", "payload", "sha").withColumn("_there", F.lit(True))
    both = requests.join(answer, "id", "left")
    same = F.lit(True)
    for c in IDENTITY:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    whole = F.sha2("payload", 256).eqNullSafe(F.col("sha"))
    status = F.when(F.col("_there").isNull(), "pending").when(~same, "foreign").when(~whole, "damaged").otherwise(F.col("status"))
    return both.select(*requests.columns, status.alias("status"), F.when(same & whole, F.col("payload")).alias("payload"))


#: Seconds after which work of a kind is given up.
LIMITS = {"job": 4 * 3600, "model": 24 * 3600, "decode": 60, "cloud": 1800}


def timed_out(work: DataFrame, now: str = "now_ms") -> DataFrame:
    """STM7: running work (kind, started_ms, cancelled) with its verdict at `now`: cancelled, timed out, or going on."""
    limit = F.element_at(F.create_map(*[F.lit(x) for kv in LIMITS.items() for x in kv]), F.col("kind")) * 1000
    return work.withColumn("verdict", F.when(F.col("cancelled"), "cancelled").when(F.col(now) - F.col("started_ms") > limit, "timed out").otherwise("running"))


def repeat_warnings(stream: DataFrame, key: str, least: int = 3) -> DataFrame:
    """STM4: a warning (first, last, n, version) once `least` equal texts in a row have come, and again, with a later end, each time the run goes on.

    Rows: key, id, b, text. Every update is emitted; latest() keeps the newest version of each. State is five values."""
    kinds = dict(stream.dtypes)

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        text, first, last, n, version = state.get if state.exists else (None, -1, -1, 0, 0)
        out = []
        for r in pd.concat(list(frames)).sort_values(["b", "id"]).itertuples():
            text, first, n = (text, first, n + 1) if text is not None and r.text == text else (r.text, int(r.id), 1)
            last = int(r.id)
            if n >= least:
                version += 1
                out.append((k[0], first, last, n, version))
        state.update((text, first, last, n, version))
        yield pd.DataFrame(out, columns=[key, "first", "last", "n", "version"])

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, first long, last long, n int, version long", "text string, first long, last long, n int, version long", "append", GroupStateTimeout.NoTimeout)


def latest(updates: DataFrame, keys: list[str], version: str = "version") -> DataFrame:
    """The newest version of each row."""
    rest = [c for c in updates.columns if c not in (*keys, version)]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("_r")).select(*keys, "_r.*")


def valid_requests(raw: DataFrame) -> DataFrame:
    """SRC8, SRC9: size, digest and field rules of a request, with the first reason that refuses it."""
    reason = F.when(F.col("uid").isNull(), "uid").when(F.octet_length("body") > 16 * 1024 * 1024, "size").when(F.sha2("body", 256) != F.col("sha"), "digest").when(~F.col("model").isin("small", "large"), "model")
    return raw.withColumn("reason", reason).withColumn("ok", F.col("reason").isNull())
