"""Queries over sampled signals and gain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import gains as A
from tidemark.functions import rational as R
from tidemark.operators import signals as G
from tidemark.plans.derive import CLIPS, SIGNAL, clips, signal, table
from tidemark.shared import folder
from tidemark.sources import sound as S
from tidemark.sources.pcm import write_pcm

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):  # noqa: ANN201
    def register(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


@query(f"WITH {SIGNAL} SELECT stream, i // 100 AS chunk, sum(x * x)::BIGINT AS energy, sqrt(sum(x * x)::DOUBLE / count(*)) AS rms, max(abs(x)) AS peak, sum(x * x) = 0 AS silent FROM sig GROUP BY ALL")
def agg1_agg2_fil10_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.energy(G.running(signal(spark, sf_dir), ["stream"], 100), ["stream", "chunk"])


@query(f"WITH {SIGNAL}, f AS (SELECT stream, i // 10 AS f, avg(x * x) AS m, count(*) AS n FROM sig GROUP BY ALL) SELECT stream, sum(CASE WHEN m >= 9 THEN n ELSE 0 END)::BIGINT AS active FROM f GROUP BY stream")
def agg3_active_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.active_length(signal(spark, sf_dir), ["stream"], 10, 9)


@query(f"WITH {SIGNAL} SELECT stream, i // 20 AS chunk FROM sig GROUP BY ALL HAVING max(abs(x)) > 4")
def fil8_silence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = G.running(signal(spark, sf_dir), ["stream"], 20).groupBy("stream", "chunk").agg(F.collect_list("x").alias("a"))
    return chunks.where(F.array_max(F.transform("a", lambda x: F.abs(x))) > 4).select("stream", "chunk")


@query(f"WITH {CLIPS}, s AS (SELECT doc, ord, unnest(range(off, off + len)) AS a1, disc - 5 AS x, tax AS gain FROM clip UNION ALL SELECT doc, ord, unnest(range(off + 1, off + len + 2)), 5 - disc, 1 FROM clip) SELECT doc, a1 AS place, sum(x * gain)::BIGINT AS x FROM s GROUP BY ALL")
def agg9_overlap_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = clips(spark, sf_dir)
    same = lambda n, x: F.transform(F.sequence(F.lit(1).cast("long"), n), lambda _: x)
    one = c.select("doc", F.col("off").alias("at"), same(F.col("len"), F.col("disc") - 5).alias("xs"), F.col("tax").alias("gain"))
    two = c.select("doc", (F.col("off") + 1).alias("at"), same(F.col("len") + 1, 5 - F.col("disc")).alias("xs"), F.lit(1).cast("long").alias("gain"))
    return G.mixed(one.unionByName(two), ["doc"], 1024).withColumnRenamed("at", "place")


@query(f"WITH {CLIPS}, s AS (SELECT doc, ord, unnest(range(off, off + len + 3)) AS a1, disc - 5 AS x, tax AS gain FROM clip) SELECT doc, a1 AS place, arg_max(x * gain, ord) AS x FROM s WHERE gain <> 0 GROUP BY ALL")
def agg19_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = clips(spark, sf_dir)
    rows = c.select("doc", F.col("ord").alias("seg"), F.explode(F.sequence(F.col("off"), F.col("off") + F.col("len") + 2)).alias("at"), (F.col("disc") - 5).alias("x"), F.col("tax").alias("gain"))
    return G.overwritten(rows, ["doc"]).withColumnRenamed("at", "place")


WEIGHTS = "w AS (SELECT * FROM (VALUES (1, 'a', 2.0::DOUBLE), (2, 'a', 2.0), (3, 'b', 0.75), (4, 'b', 0.75), (5, 'b', 0.75)) v(channel, component, gain)), wn AS (SELECT *, count(*) OVER (PARTITION BY component) AS n FROM w)"


@query(f"WITH {CLIPS}, {WEIGHTS} SELECT doc, sum((disc - 5) * gain / n) AS x FROM clip JOIN wn ON channel = ord GROUP BY doc")
def agg10_mat7_channel_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = spark.createDataFrame([(1, "a", 2.0), (2, "a", 2.0), (3, "b", 0.75), (4, "b", 0.75), (5, "b", 0.75)], "channel long, component string, gain double")
    return G.channel_mean(clips(spark, sf_dir).select("doc", F.col("ord").alias("channel"), (F.col("disc") - 5).alias("x")), weights, ["doc"])


@query("SELECT p_partkey, CASE WHEN d BETWEEN -96 AND 12 THEN pow(10.0, d / 20.0) END AS gain FROM (SELECT p_partkey, (p_size * 3 - 110)::DOUBLE AS d FROM part)")
def mat1_db_to_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat((F.col("p_size") * 3 - 110).cast("string"), F.lit("dB"))
    return table(spark, sf_dir, "part").select("p_partkey", G.amplitude(G.parse_db(text)).alias("gain"))


CURVE = "CASE p_partkey % 4 WHEN 0 THEN p WHEN 1 THEN sin(p * pi() / 2) WHEN 2 THEN 1 - cos(p * pi() / 2) ELSE (1 - cos(p * pi())) / 2 END"


@query(f"SELECT p_partkey, round({CURVE}, 9) AS y FROM (SELECT p_partkey, p_size / 50.0::DOUBLE AS p FROM part)")
def mat2_fade_easing(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.get(F.array(*[F.lit(x) for x in ("linear", "easeIn", "easeOut", "easeInOut")]), (F.col("p_partkey") % 4).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(A.easing(kind, F.col("p_size") / 50.0), 9).alias("y"))


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, ord, t, g: clips with a gain of one curve: a clock, two fades, and for two clips in three two or three keyframes."""
    c = clips(spark, sf_dir)
    fade = lambda n, kind: F.struct(n.cast("double").alias("length"), kind.alias("kind"))
    kind = F.get(F.array(*[F.lit(x) for x in ("linear", "easeIn", "easeOut", "both")]), (F.col("asset") % 4).cast("int"))
    key = lambda at, db: F.struct(at.cast("double").alias("time"), db.cast("double").alias("db"))
    two = [key(F.col("disc"), F.col("tax") - 9), key(F.col("disc") + F.col("tax") + 1, F.col("disc") - 3)]
    keys = F.when(F.col("asset") % 3 == 1, F.array(*two)).when(F.col("asset") % 3 == 2, F.array(*two, key(F.col("disc") + F.col("tax") + 5, F.lit(-20))))
    keys = F.coalesce(keys, F.array().cast("array<struct<time:double,db:double>>"))
    curve = F.struct(F.lit(0.5).alias("scale"), F.col("disc").cast("double").alias("shift"), (F.col("len") * 2).cast("double").alias("length"), (F.col("disc") - 5).cast("double").alias("base"), fade(F.col("tax"), kind).alias("fade_in"), fade(F.col("disc"), kind).alias("fade_out"), keys.alias("keys"))
    return c.select("doc", "ord", "off", "len", "disc", "tax", A.gain((F.col("tax") + 1) / 4.0, F.array(curve)).alias("g"), curve.alias("curve"))


ENVELOPE = CLIPS + """,
ev AS (SELECT doc, ord, off, len, disc, tax, asset % 4 AS kind, asset % 3 AS n, (tax + 1) / 4.0::DOUBLE AS factor, 0.5::DOUBLE AS scale, disc::DOUBLE AS shift FROM clip),
ky AS (SELECT *, disc::DOUBLE AS t1, pow(10, (tax - 9) / 20.0::DOUBLE) AS a1, (disc + tax + 1)::DOUBLE AS t2, pow(10, (disc - 3) / 20.0::DOUBLE) AS a2, (disc + tax + 5)::DOUBLE AS t3, pow(10, -20 / 20.0::DOUBLE) AS a3 FROM ev)
"""


def ease(p: str) -> str:
    x = f"least(greatest({p}, 0), 1)"
    return f"CASE kind WHEN 0 THEN {x} WHEN 1 THEN sin({x} * pi() / 2) WHEN 2 THEN 1 - cos({x} * pi() / 2) ELSE (1 - cos({x} * pi())) / 2 END"


LEVEL = f"""CASE n WHEN 0 THEN 1 ELSE (CASE WHEN age <= t1 THEN a1 WHEN age < t2 THEN a1 + (a2 - a1) * (age - t1) / (t2 - t1) WHEN n = 1 THEN a2 WHEN age < t3 THEN a2 + (a3 - a2) * (age - t2) / (t3 - t2) ELSE a3 END) / pow(10, (disc - 5) / 20.0::DOUBLE) END
 * CASE WHEN tax > 0 THEN {ease("age / tax::DOUBLE")} ELSE 1 END * CASE WHEN disc > 0 THEN {ease("(2 * len - age) / disc::DOUBLE")} ELSE 1 END"""


@query(f"WITH {ENVELOPE} SELECT doc, ord, t, round(factor * {LEVEL}, 9) AS gain FROM (SELECT *, scale * t + shift AS age FROM (SELECT *, unnest(range(0, 24, 3)) AS t FROM ky))")
def mat3_keyframed_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight times of every clip's curve."""
    at = envelopes(spark, sf_dir).withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(21).cast("long"), F.lit(3).cast("long"))))
    return at.select("doc", "ord", "t", F.round(A.gain_at(F.col("g"), F.col("t").cast("double")), 9).alias("gain"))


@query(f"""WITH {ENVELOPE}, a AS (SELECT *, scale * 7 + shift AS age FROM ky), v AS (SELECT *, factor * {LEVEL} AS g FROM a), p AS (SELECT x.doc, x.ord, x.g AS g, y.g AS h, x.factor AS f, x.disc AS d, y.factor AS k FROM v x JOIN v y ON y.doc = x.doc AND y.ord = x.ord + 1)
SELECT doc, ord, round(g * h, 9) AS product, round(g / k, 9) AS quotient, CASE WHEN d > 0 THEN round(f * k / d, 9) END AS static, true AS refused FROM p""")
def mat5_gain_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products and quotients of each clip's gain with the next one's; a curve does not divide, and static gains fold to one factor."""
    e = envelopes(spark, sf_dir)
    after = e.select("doc", (F.col("ord") - 1).alias("ord"), F.col("g").alias("h"))
    p = e.join(after, ["doc", "ord"])
    t, flat = F.lit(7.0), A.gain(F.col("h.factor"))
    plain = A.over(A.times(A.gain(F.col("g.factor")), flat), A.gain(F.col("disc")))
    return p.select("doc", "ord", F.round(A.gain_at(A.times(F.col("g"), F.col("h")), t), 9).alias("product"), F.round(A.gain_at(A.over(F.col("g"), flat), t), 9).alias("quotient"), F.round(A.static(plain), 9).alias("static"), A.over(F.col("g"), F.col("h")).isNull().alias("refused"))


@query(f"WITH {CLIPS} SELECT doc, ord, 0.5::DOUBLE * ((off + 3) + 2 * (t - off)) + disc AS age, t FROM (SELECT *, unnest([off, off + 1, off + len]) AS t FROM clip)")
def mat4_clock_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A curve's clock after a clip that plays its source from off + 3, twice as fast: the same age at every time."""
    e = envelopes(spark, sf_dir)
    moved = e.select("doc", "ord", A.remapped(F.col("curve"), F.col("off") + 3, F.col("off"), F.lit(2)).alias("c"), F.explode(F.array(F.col("off"), F.col("off") + 1, F.col("off") + F.col("len"))).alias("t"))
    return moved.select("doc", "ord", (F.col("c.scale") * F.col("t") + F.col("c.shift")).alias("age"), "t")


@query(f"WITH {CLIPS}, b AS (SELECT doc, ord, len, off, unnest(range(0, (len + 9) // 10)) AS k FROM clip) SELECT doc, ord, k, off + k * 10 AS out_from, off + least(len, k * 10 + 10) AS out_to, (k * 10) * 3 // 2 AS src_from, least(len, k * 10 + 10) * 3 // 2 AS src_to FROM b")
def mat9_render_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = clips(spark, sf_dir).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), R.floor_div(F.col("len") + 9, F.lit(10)) - 1)))
    stop = F.least(F.col("len"), F.col("k") * 10 + 10)
    return c.select("doc", "ord", "k", (F.col("off") + F.col("k") * 10).alias("out_from"), (F.col("off") + stop).alias("out_to"), R.floor_div(F.col("k") * 30, F.lit(2)).alias("src_from"), R.floor_div(stop * 3, F.lit(2)).alias("src_to"))


SEGMENTS = SIGNAL + """,
sg AS (SELECT doc, ord, doc // 2048 AS stream, off, len AS n, ord * 7 + effect % 5 AS s0, len * (1 + tax % 3) // 2 + 1 AS m, 1 + disc % 3 AS gain, CASE WHEN disc % 2 = 1 THEN 4 ELSE 0 END AS fade FROM clip)"""


def sound(spark: SparkSession, sf_dir: str, range_samples: int, row: int) -> DataFrame:
    """Each stream's samples in a file of its own, read again in ranges."""
    where = folder(spark, "sound").removeprefix("file://").removeprefix("file:")
    S.put_files(write_pcm(signal(spark, sf_dir), ["stream"]).select(F.concat(F.col("stream").cast("string"), F.lit(".f32")).alias("name"), "content"), where)
    spark.dataSource.register(S.Sound)
    return spark.read.format("tidemark_sound").options(path=where, row=str(row), range=str(range_samples)).load()


@query(f"WITH {SIGNAL} SELECT stream, i // 500 * 500 AS start, count(*)::INTEGER AS n, sum(x * (i % 500 + 1))::DOUBLE AS total, true AS ok FROM sig GROUP BY ALL")
def src6_src7_split_sound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that no task reads whole: ranges of 1,000 samples, rows of 500; each sample at its place."""
    total = F.aggregate(F.transform("samples", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return sound(spark, sf_dir, 1000, 500).select(F.split_part("file", F.lit("."), F.lit(1)).cast("long").alias("stream"), "start", F.size("samples").alias("n"), total.alias("total"), "ok")


@query(f"""WITH {SEGMENTS}, o AS (SELECT *, unnest(range(n)) AS i FROM sg), g AS (SELECT doc, off + o.i AS place, x * gain * CASE WHEN o.i < fade THEN o.i / fade::DOUBLE ELSE 1 END AS y FROM o JOIN sig ON sig.stream = o.stream AND sig.i = s0 + o.i * m // n)
SELECT doc, place, sum(y)::DOUBLE AS x FROM g GROUP BY ALL""")
def mat9_agg9_rendered_sound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments rendered from files at their speeds, block by block, and mixed at their places."""
    c, n = clips(spark, sf_dir), F.col("len")
    segments = c.select("doc", F.concat(F.floor(F.col("doc") / 2048).cast("string"), F.lit(".f32")).alias("file"), F.col("off").alias("start_sample"), n.alias("samples"), (F.col("ord") * 7 + F.col("effect") % 5).alias("source_sample"), (S.whole(n * (1 + F.col("tax") % 3), 2) + 1).alias("source_samples"), (1 + F.col("disc") % 3).cast("double").alias("gain"), F.when(F.col("disc") % 2 == 1, 4).otherwise(0).cast("long").alias("fade_in"), F.lit(0).cast("long").alias("fade_out"))
    parts = S.rendered(segments, sound(spark, sf_dir, 4000, 500), block=16, row=500)
    mixed = G.mixed(parts.select("doc", F.col("start").alias("at"), F.col("samples").alias("xs"), F.lit(1.0).alias("gain")), ["doc"], 1024)
    return mixed.select("doc", F.col("at").alias("place"), F.col("x").cast("double").alias("x"))


@query(f"WITH {SIGNAL} SELECT stream, i, round_even(least(greatest(x / 4.0::DOUBLE, -1), 1) * 32767, 0)::INTEGER AS pcm FROM sig")
def snk7_pcm16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal(spark, sf_dir).select("stream", "i", G.pcm16(F.col("x") / 4.0).alias("pcm"))


@query(f"WITH {SIGNAL}, c AS (SELECT stream, i // 200 AS chunk, count(*) FILTER (x <> 0) AS active, sqrt(sum(x * x)::DOUBLE / count(*)) AS rms, sum(CASE WHEN x = 5 THEN 1 ELSE 0 END) AS chars FROM sig GROUP BY ALL) SELECT stream, chunk FROM c WHERE chars <= 15 AND active >= 170 AND rms >= 3")
def fil22_signal_without_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    c = G.running(signal(spark, sf_dir), ["stream"], 200).groupBy("stream", "chunk").agg(F.count_if(x != 0).alias("active"), F.sqrt(F.sum(x * x) / F.count(F.lit(1))).alias("rms"), F.count_if(x == 5).alias("chars"))
    return c.where("chars <= 15 AND active >= 170 AND rms >= 3").select("stream", "chunk")


def cuts(most: int, search: int, step: int) -> str:
    """Chunk after chunk in SQL: where the next one begins is the middle of the quietest ten samples."""
    return f"""{SIGNAL}, en AS (SELECT stream, i, sum(x * x) OVER (PARTITION BY stream ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS level FROM sig), sz AS (SELECT stream, count(*) AS total FROM sig GROUP BY stream),
ch(stream, chunk, b) AS (SELECT stream, 0, 0::BIGINT FROM sz UNION ALL SELECT ch.stream, chunk + 1, arg_min(i, (level, i)) + 5 FROM ch JOIN sz ON sz.stream = ch.stream JOIN en ON en.stream = ch.stream AND i >= b + {search} AND i <= b + {most - 10} AND (i - b - {search}) % {step} = 0 WHERE total - b > {most} GROUP BY ch.stream, chunk, b)
SELECT ch.stream, chunk::INTEGER AS chunk, b AS begin, coalesce(lead(b) OVER (PARTITION BY ch.stream ORDER BY chunk), total) AS end FROM ch JOIN sz ON sz.stream = ch.stream"""


@query("WITH RECURSIVE " + cuts(250, 200, 10))
def win10_energy_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.chunked(signal(spark, sf_dir), ["stream"], 250, 200, 10, 10)


@query("WITH RECURSIVE " + cuts(600, 550, 1))
def win11_cloud_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.chunked(signal(spark, sf_dir), ["stream"], 600, 550, 10, 1)


@query(f"WITH {SIGNAL} SELECT stream, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS sha FROM sig GROUP BY stream")
def agg16_stream_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests do not compose from parts: one group for each stream."""
    return signal(spark, sf_dir).groupBy("stream").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda r: r["x"].cast("string")), ","), 256).alias("sha"))
