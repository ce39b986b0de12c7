"""Queries over the job queue and its streams."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.derive import INTERVALS, intervals, table
from tidemark.streaming import jobs as J
from tidemark.streaming import live as L

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):  # noqa: ANN201
    def register(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.polled(spark, f"{sf_dir}/events*.parquet", table(spark, sf_dir, "events").schema)


@query("SELECT event_id, user_id, event_type FROM events")
def src11_src13_stm1_directory_poll(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.run_to_files(event_stream(spark, sf_dir).select("event_id", "user_id", "event_type"), J.folder(spark, "poll"))


@query("SELECT event_id, (line->>'page')::VARCHAR AS page FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN left(props, length(props) - 1) WHEN event_id % 7 = 0 THEN 'started ' || props ELSE props END AS line FROM events) WHERE json_valid(line)")
def src12_stm9_log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole JSON lines among cut and foreign ones."""
    n = F.col("event_id")
    line = F.when(n % 5 == 0, F.expr("left(props, char_length(props) - 1)")).when(n % 7 == 0, F.concat(F.lit("started "), "props")).otherwise(F.col("props"))
    lines = event_stream(spark, sf_dir).select("event_id", line.alias("line"))
    return J.run_to_files(J.log_tail(lines, "line", "page string"), J.folder(spark, "tail"))


@query(f"""WITH RECURSIVE {INTERVALS}, n AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY b, id) AS k FROM iv),
g(u, k, id, ok, stop, text, run) AS (SELECT u, k, id, true, e, event_type, 1 FROM n WHERE k = 1
 UNION ALL SELECT n.u, n.k, n.id, n.b >= stop, CASE WHEN n.b >= stop THEN n.e ELSE stop END, CASE WHEN n.b >= stop THEN event_type ELSE text END, CASE WHEN n.b >= stop THEN CASE WHEN event_type = text THEN run + 1 ELSE 1 END ELSE run END FROM g JOIN n ON n.u = g.u AND n.k = g.k + 1)
SELECT u, id, ok, CASE WHEN ok THEN run ELSE 0 END AS run FROM g""")
def stm2_stm3_stm4_ordered_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.unix_micros(F.col("ts").cast("timestamp"))
    s = table(spark, sf_dir, "events").select(F.col("user_id").alias("u"), F.col("event_id").alias("id"), b.alias("b"), (b + F.round(F.col("value") * 1000).cast("long") * 1000).alias("e"), F.col("event_type").alias("text"))
    return L.grown(J.thirds(s, "b"), J.folder(spark, "runs"), lambda stream: J.ordered_runs(stream, "u"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 1 THEN 'failed' ELSE 'done' END AS status FROM events")
def stm5_stm6_snk8_at_most_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three files come one by one; work on the second stops after it was claimed. Taken up again, its jobs are failed, not worked on twice."""
    where = J.folder(spark, "once")
    events = table(spark, sf_dir, "events").select("event_id", "value")
    worked: list[int] = []
    for k in range(3):
        events.where(F.col("event_id") % 3 == k).coalesce(1).write.mode("append").parquet(f"{where}/in")

    def work(df: DataFrame) -> DataFrame:
        k = df.select(F.max(F.col("event_id") % 3)).first()[0]
        worked.append(k)
        if k == 1:
            raise RuntimeError("stopped")
        return df

    for _ in range(2):
        try:
            J.once(J.polled(spark, f"{where}/in", events.schema), where, "event_id", work)
        except StreamingQueryException:
            if worked[-1] != 1:
                raise
    if worked.count(1) != 1:
        raise RuntimeError(f"a claimed batch was worked on again: {worked}")
    return spark.read.parquet(f"{where}/answers").select("event_id", "status")


REQUESTS = "rq AS (SELECT event_id AS id, CASE WHEN event_id % 50 = 0 THEN NULL ELSE user_id END AS uid, props AS body, CASE WHEN event_id % 7 = 0 THEN 'x' ELSE sha256(props) END AS sha, CASE WHEN event_id % 11 = 0 THEN 'huge' ELSE 'small' END AS model FROM events)"


@query(f"WITH {REQUESTS} SELECT id, CASE WHEN uid IS NULL THEN 'uid' WHEN octet_length(encode(body)) > 16777216 THEN 'size' WHEN sha256(body) <> sha THEN 'digest' WHEN model NOT IN ('small', 'large') THEN 'model' END AS reason FROM rq")
def src8_src9_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    n = F.col("event_id")
    raw = e.select(n.alias("id"), F.when(n % 50 != 0, F.col("user_id")).alias("uid"), F.col("props").alias("body"), F.when(n % 7 == 0, "x").otherwise(F.sha2("props", 256)).alias("sha"), F.when(n % 11 == 0, "huge").otherwise("small").alias("model"))
    return J.valid_requests(raw).select("id", "reason")


@query("""WITH rq AS (SELECT event_id AS id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE user_id END AS uid, 'small' AS model, event_type AS vocabulary, value, props FROM events)
SELECT id, CASE WHEN NOT value > 20 THEN 'pending' WHEN id % 9 = 0 OR id % 8 = 0 AND uid IS NOT NULL THEN 'foreign' WHEN id % 7 = 0 THEN 'damaged' ELSE 'ready' END AS status,
CASE WHEN value > 20 AND NOT (id % 9 = 0 OR id % 8 = 0 AND uid IS NOT NULL) AND id % 7 <> 0 THEN props END AS payload FROM rq""")
def snk8_snk15_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses to most requests: some are of another model or user, some were damaged after their digest was written."""
    n = F.col("event_id")
    e = table(spark, sf_dir, "events").select(n.alias("id"), F.when(n % 10 != 0, F.col("user_id")).alias("uid"), F.lit("small").alias("model"), F.col("event_type").alias("vocabulary"), "value", "props")
    i = F.col("id")
    answers = e.where("value > 20").select("id", F.when(i % 8 != 0, F.col("uid")).alias("uid"), F.when(i % 9 == 0, "large").otherwise("small").alias("model"), "vocabulary", F.lit("ready").alias("status"), F.when(i % 7 == 0, F.concat("props", F.lit(" "))).otherwise(F.col("props")).alias("payload"), F.sha2("props", 256).alias("sha"))
    return J.published(e.select("id", "uid", "model", "vocabulary"), answers).select("id", "status", "payload")


@query("SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'cancelled' WHEN value * 1000 > CASE event_id % 4 WHEN 0 THEN 14400 WHEN 1 THEN 86400 WHEN 2 THEN 60 ELSE 1800 END THEN 'timed out' ELSE 'running' END AS verdict FROM events")
def stm7_time_outs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    kind = F.get(F.array(*map(F.lit, ("job", "model", "decode", "cloud"))), (n % 4).cast("int"))
    e = table(spark, sf_dir, "events").select("event_id", kind.alias("kind"), F.lit(0.0).alias("started_ms"), (F.col("value") * 1000000).alias("now_ms"), (n % 13 == 0).alias("cancelled"))
    return J.timed_out(e).select("event_id", "verdict")


@query(f"""WITH {INTERVALS}, n AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY u ORDER BY b, id) THEN 0 ELSE 1 END AS new FROM iv),
r AS (SELECT *, sum(new) OVER (PARTITION BY u ORDER BY b, id) AS run FROM n) SELECT u, arg_min(id, (b, id)) AS first, arg_max(id, (b, id)) AS last, count(*)::INTEGER AS n FROM r GROUP BY u, run HAVING count(*) >= 3""")
def stm4_updated_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings whose end moves while the run goes on: every update is a row, the newest of each counts."""
    b = F.unix_micros(F.col("ts").cast("timestamp"))
    s = table(spark, sf_dir, "events").select(F.col("user_id").alias("u"), F.col("event_id").alias("id"), b.alias("b"), F.col("event_type").alias("text"))
    return J.latest(L.grown(J.thirds(s, "b"), J.folder(spark, "warnings"), lambda stream: J.repeat_warnings(stream, "u")), ["u", "first"])


@query(f"""WITH RECURSIVE {INTERVALS}, n AS (SELECT u, id, b, b + 1 AS e, event_type, row_number() OVER (PARTITION BY u ORDER BY b, id) AS k FROM iv),
g(u, k, id, b, ok, stop, chunks, text, first, run) AS (SELECT u, k, id, b, true, e, 1, event_type, id, 1 FROM n WHERE k = 1
 UNION ALL SELECT n.u, n.k, n.id, n.b, n.b >= stop, CASE WHEN n.b >= stop THEN n.e ELSE stop END, chunks + (n.b >= stop)::INTEGER, CASE WHEN n.b >= stop THEN event_type ELSE text END,
  CASE WHEN n.b >= stop AND event_type <> text THEN n.id ELSE first END, CASE WHEN n.b < stop THEN run WHEN event_type = text THEN run + 1 ELSE 1 END FROM g JOIN n ON n.u = g.u AND n.k = g.k + 1),
s AS (SELECT *, sum((ok AND run = 3)::INTEGER) OVER (PARTITION BY u ORDER BY k) AS warnings FROM g)
SELECT u, CASE WHEN ok THEN 'record' ELSE 'error' END AS kind, id, CASE WHEN ok THEN chunks ELSE 0 END AS n, 0 AS version FROM s WHERE NOT ok OR chunks <= 40
UNION ALL SELECT u, 'warning', first, run, run - 2 FROM s WHERE ok AND run >= 3 AND warnings <= 5""")
def stm2_stm3_stm4_win18_diagnosed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed state with bounds (40 records, 5 warnings a user), over a folder that grows and a query that stops twice."""
    b = F.unix_micros(F.col("ts").cast("timestamp"))
    s = table(spark, sf_dir, "events").select(F.col("user_id").alias("u"), F.col("event_id").alias("id"), b.alias("b"), (b + 1).alias("e"), F.col("event_type").alias("text"))
    return L.grown(J.thirds(s, "b"), J.folder(spark, "diagnosed"), lambda stream: L.diagnosed(stream, "u", exact=False, most_chunks=40, most_warnings=5)).select("u", "kind", "id", "n", "version")


@query("SELECT event_id, (props->>'page')::VARCHAR AS page FROM events")
def src12_growing_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs of JSON lines that grow twice, the first time in the middle of a line: each event once, by byte offsets."""
    where = J.folder(spark, "logs")
    spark.dataSource.register(L.LogTail)
    lines = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit('{"id":'), F.col("event_id").cast("string"), F.lit(',"p":'), "props", F.lit("}")).alias("line"), F.floor(F.col("event_id") / 2000).alias("log"))
    for half in (0, 1):
        L.append_lines(lines, f"{where}/in", half)
        out = J.run_to_files(spark.readStream.format("tidemark_log_tail").option("path", f"{where}/in").load(), where)
    return out.select(F.get_json_object("line", "$.id").cast("long").alias("event_id"), F.get_json_object("line", "$.p.page").alias("page"))


@query("SELECT n_nationkey AS nation, CASE WHEN n_nationkey % 6 = 5 THEN 'cancelled' ELSE 'done' END AS status, CASE WHEN n_nationkey % 6 <> 5 THEN (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) END AS customers FROM nation")
def stm1_stm5_snk5_served_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request folder for each nation, served by name, one at a time; some are cancelled before. The answers are read from the files."""
    where = J.folder(spark, "queue")
    key = F.lpad(F.col("n_nationkey").cast("string"), 4, "0")
    nations = table(spark, sf_dir, "nation").select(key.alias("name"), F.to_json(F.struct(F.col("n_nationkey").alias("nation"))).alias("request"), (F.col("n_nationkey") % 6 == 5).alias("cancelled"))
    L.put_requests(nations, f"{where}/in")
    customers = table(spark, sf_dir, "customer")

    def work(df: DataFrame) -> DataFrame:
        asked = df.withColumn("nation", F.get_json_object("request", "$.nation").cast("int"))
        return asked.join(customers, F.col("nation") == F.col("c_nationkey"), "left").groupBy("name").agg(F.count("c_custkey").alias("result"))

    L.serve(spark, f"{where}/in", where, work, listener=False)
    answers = spark.read.schema("status string, result string").json(f"{where}/in/*/response.json").withColumn("nation", F.regexp_extract(F.input_file_name(), r"/(\d+)/response", 1).cast("int"))
    return answers.select("nation", "status", F.col("result").cast("long").alias("customers"))


@query("SELECT conv_id, turn, role, text FROM conversations")
def src14_snk5_json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results saved as JSON by the committer and read again with their schema."""
    rows = table(spark, sf_dir, "conversations")
    where = J.folder(spark, "json")
    rows.write.json(where)
    return spark.read.schema(rows.schema).json(where)


@query(f"WITH {INTERVALS}, c AS (SELECT u, id, b, lead(b) OVER (PARTITION BY u ORDER BY b, id) AS nb FROM iv) SELECT u, count(*) AS n, count(*) FILTER (nb - b < 3600000000) AS close FROM c GROUP BY u")
def src18_style_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    iv = intervals(spark, sf_dir).withColumn("nb", F.lead("b").over(Window.partitionBy("u").orderBy("b", "id")))
    return iv.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("nb") - F.col("b") < 3_600_000_000).alias("close"))
