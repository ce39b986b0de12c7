"""Queries over PCM, project documents, volumes and components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.derive import CLIPS, SIGNAL, clips, signal, table
from tidemark.plans.tokens import BLOCKS, blocks, slice_caption_conversations
from tidemark.sources import pcm as P
from tidemark.sources.cloud import results

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):  # noqa: ANN201
    def register(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


@query(f"WITH {SIGNAL} SELECT stream, count(*) AS samples, sqrt(sum(x * x)::DOUBLE / count(*)) AS rms, sum(x * x) = 0 AS silent FROM sig GROUP BY stream")
def snk6_write_pcm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.write_pcm(signal(spark, sf_dir), ["stream"]).select("stream", "samples", "rms", "silent")


@query(f"WITH {SIGNAL} SELECT stream, i // 1000 * 1000 AS start, count(*)::BIGINT AS n, sum(x)::DOUBLE AS total, true AS ok FROM sig GROUP BY ALL")
def src6_src7_read_pcm(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = P.read_pcm(P.write_pcm(signal(spark, sf_dir), ["stream"]), ["stream"], most=1000)
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return back.select("stream", "start", F.size("samples").cast("long").alias("n"), total.alias("total"), "ok")


@query("""SELECT page_id, regexp_matches(lower(name), '\\.(wav|aif|aiff|m4a|mp3|caf)$') AND octet_length(encode(html)) BETWEEN 1 AND 3000 AND page_id % 4 <> 0 AS ok
FROM (SELECT *, url || CASE page_id % 3 WHEN 0 THEN '.WAV' WHEN 1 THEN '.mp3' ELSE '.ogg' END AS name FROM pages)""")
def fil20_file_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suffix, size and digest; every fourth file is not the one whose digest was noted."""
    n = F.col("page_id")
    p = table(spark, sf_dir, "pages").withColumn("name", F.concat("url", F.get(F.array(*map(F.lit, (".WAV", ".mp3", ".ogg"))), (n % 3).cast("int"))))
    noted = F.when(n % 4 == 0, F.sha2(F.concat("html", F.lit("!")), 256)).otherwise(F.sha2("html", 256))
    return p.select("page_id", P.valid_file(F.col("name"), F.octet_length("html"), F.sha2("html", 256), noted, 3000).alias("ok"))


@query(f"WITH {CLIPS} SELECT doc, ord, CASE WHEN disc = 0 THEN 1.0::DOUBLE WHEN disc * 20 - 170 BETWEEN -96 AND 12 THEN pow(10.0, (disc * 20 - 170) / 20.0::DOUBLE) END AS gain FROM clip")
def mat6_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    attrs = F.when(F.col("disc") == 0, F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.lit("amount"), F.concat((F.col("disc") * 20 - 170).cast("string"), F.lit("dB"))))
    return clips(spark, sf_dir).select("doc", "ord", P.volume(attrs).alias("gain"))


@query(f"WITH {CLIPS}, s AS (SELECT doc, unnest([effect % 6, (effect + disc) % 6]) AS channel, tax AS gain FROM clip WHERE tax > 2) SELECT doc, count(*) AS named, count(DISTINCT channel) AS channels, sum(gain)::BIGINT AS gain, count(*) = count(DISTINCT channel) AS ok FROM s GROUP BY doc")
def mat8_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = clips(spark, sf_dir).select("doc", F.array(F.col("effect") % 6, (F.col("effect") + F.col("disc")) % 6).alias("channels"), F.col("tax").alias("gain"), (F.col("tax") > 2).alias("active"))
    return P.components(s, ["doc"])


@query(f"""WITH {BLOCKS}, f AS (SELECT doc, block, start_ms * 25 // 1000 AS a, (end_ms * 25 + 999) // 1000 AS b, text FROM cap), g AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc ORDER BY block), 0) AS p FROM f),
t AS (SELECT doc, a, b, 'title' AS kind, text FROM f UNION ALL SELECT doc, p, a, 'gap', '' FROM g WHERE a > p)
SELECT doc, '<spine>' || string_agg('<' || kind || CASE kind WHEN 'title' THEN ' name="' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '"', '&quot;') || '"' ELSE '' END || ' offset="' || a || '/25s" duration="' || (b - a) || '/25s"/>', '' ORDER BY a, kind) || '</spine>' AS xml FROM t GROUP BY doc""")
def snk3_title_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.operators.intervals import tiled

    f = slice_caption_conversations(spark, sf_dir).select(F.col("conv_id").alias("doc"), "caption_no", F.col("start_frame").alias("a"), F.col("end_frame").alias("b"), "text")
    tiles = tiled(f, f.groupBy("doc").agg(F.max("b").alias("total")))
    texts = f.select("doc", "a", "b", "text", F.lit("title").alias("kind"))
    rows = tiles.join(texts, ["doc", "a", "b", "kind"], "left").na.fill("", ["text"])
    return P.payload(rows, "doc")


NODES = "nd AS MATERIALIZED (SELECT doc, 0 AS id, NULL AS parent, 0 AS ord, 'spine' AS tag FROM clip GROUP BY doc UNION ALL SELECT doc, ord, 0, ord, CASE WHEN disc < 3 THEN 'title' ELSE 'clip' END FROM clip UNION ALL SELECT doc, 100 + ord, ord, 0, CASE WHEN tax < 3 THEN 'title' ELSE 'audio' END FROM clip)"


@query(f"WITH {CLIPS}, {NODES} SELECT n.doc, n.id::BIGINT AS id, CASE n.tag WHEN 'title' THEN 'gap' ELSE n.tag END AS tag FROM nd n LEFT JOIN nd p ON p.doc = n.doc AND p.id = n.parent WHERE n.tag <> 'title' OR p.tag = 'spine'")
def src2_without_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = clips(spark, sf_dir)
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    tagged = lambda test, other: F.when(test, "title").otherwise(other)
    spine = c.select("doc", zero.alias("id"), none.alias("parent"), zero.alias("ord"), F.lit("spine").alias("tag")).distinct()
    story = c.select("doc", F.col("ord").alias("id"), zero.alias("parent"), "ord", tagged(F.col("disc") < 3, "clip").alias("tag"))
    inner = c.select("doc", (F.col("ord") + 100).alias("id"), F.col("ord").alias("parent"), zero.alias("ord"), tagged(F.col("tax") < 3, "audio").alias("tag"))
    nodes = spine.unionByName(story).unionByName(inner).withColumn("attrs", F.create_map(F.lit("name"), F.col("tag")))
    return P.without_titles(nodes).select("doc", "id", "tag")


@query("""SELECT k AS clips, '<fcpxml><project uid="p' || k || '"><sequence duration="' || (k * 2) || 's"><spine>' || (SELECT string_agg('<clip offset="' || (i * 2) || 's" duration="2s" ref="r' || (i + 1) || '"/>', '' ORDER BY i) FROM range(64) r(i) WHERE i < k)
|| '</spine></sequence></project></fcpxml>' AS xml FROM range(1, 65) t(k)""")
def src20_generated_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.generated(spark, 64)


@query("""WITH e AS (SELECT item_id, unnest(string_split(text, ' ')) AS text, generate_subscripts(string_split(text, ' '), 1) AS k FROM benchmark),
p AS (SELECT *, (sum(length(text) + 1) OVER (PARTITION BY item_id ORDER BY k) - 1)::DOUBLE AS "end" FROM e) SELECT item_id, text, "end" - length(text) AS "start", "end" FROM p WHERE text <> ''""")
def udf1_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An injected engine that hears a word between any two silent samples, as a lateral table function."""

    def heard(samples: list) -> list:
        out, begin = [], None
        for i, x in enumerate([*samples, " "]):
            if x != " " and begin is None:
                begin = i
            elif x == " " and begin is not None:
                out.append(("".join(samples[begin:i]), float(begin), float(i)))
                begin = None
        return out

    engine = P.engine(heard)
    items = table(spark, sf_dir, "benchmark").select("item_id", F.split("text", "").alias("samples"))
    return items.lateralJoin(engine(F.col("samples").outer())).select("item_id", "text", "start", "end")


SAID = """pw AS (SELECT b.doc, b.block, row_number() OVER (PARTITION BY b.doc, b.block ORDER BY b.pos) - 1 AS n, b.pos, text, b.start_ms, b.end_ms FROM blk b)"""


@query(f"""WITH {BLOCKS}, {SAID}, z AS (SELECT doc, max(end_ms) AS d FROM pw GROUP BY doc), x AS (SELECT doc, CASE WHEN doc % 11 = 0 THEN 'structure' WHEN doc % 7 = 0 THEN 'times' WHEN doc % 5 = 0 THEN 'alignment' WHEN doc % 3 = 0 THEN 'text' END AS reason, d FROM z)
SELECT pw.doc, block::INTEGER AS utterance, n::INTEGER AS n, CASE WHEN regexp_matches(lag(text) OVER (PARTITION BY pw.doc, block ORDER BY pos), '[A-Za-z0-9]$') AND regexp_matches(text, '^[A-Za-z0-9]') THEN ' ' ELSE '' END || text AS text, 10 + start_ms / 1000.0::DOUBLE AS "start", 10 + end_ms / 1000.0::DOUBLE AS "end", NULL::VARCHAR AS reason
FROM pw JOIN x ON x.doc = pw.doc WHERE reason IS NULL UNION ALL SELECT doc, NULL, NULL, NULL, NULL, NULL, reason FROM x WHERE reason IS NOT NULL""")
def str17_cloud_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results in JSON, some without structure, with a time beyond the end, a changed utterance, or a changed whole."""
    w = blocks(spark, sf_dir)
    late = F.when((F.col("doc") % 7 == 0) & (F.col("pos") == 1), 10**9).otherwise(0)
    word = F.struct("pos", "text", F.col("start_ms").cast("double").alias("start_time"), (F.col("end_ms") + late).cast("double").alias("end_time"))
    said = w.groupBy("doc", "block").agg(F.array_sort(F.collect_list(word)).alias("p"), F.max("end_ms").alias("stop"))
    text = F.concat(F.array_join(F.transform("p", lambda x: x["text"]), " "), F.when((F.col("doc") % 5 == 0) & (F.col("block") == 0), " more").otherwise(""))
    spoken = said.select("doc", "stop", F.struct("block", text.alias("text"), F.transform("p", lambda x: F.struct(x["text"].alias("text"), x["start_time"].alias("start_time"), x["end_time"].alias("end_time"))).alias("words")).alias("u"))
    docs = spoken.groupBy("doc").agg(F.array_sort(F.collect_list("u")).alias("u"), (F.max("stop") / 1000.0).alias("duration"))
    whole = F.concat(F.array_join(F.transform("u", lambda x: x["text"]), " "), F.when(F.col("doc") % 3 == 0, " end").otherwise(""))
    plain = F.transform("u", lambda x: F.struct(x["text"].alias("text"), x["words"].alias("words")))
    body = F.when(F.col("doc") % 11 == 0, '{"result": {"text": "x"}}').otherwise(F.to_json(F.struct(F.struct(whole.alias("text"), plain.alias("utterances")).alias("result"))))
    rows = docs.select("doc", body.alias("body"), "duration", F.lit(10.0).alias("offset"))
    return results(rows, "doc", "body", "duration", "offset")
