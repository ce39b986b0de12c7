"""Queries over channel layers of project documents, from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.plans.derive import table
from tidemark.shared import folder
from tidemark.sources import channels as C
from tidemark.sources import timeline as N

QUERIES, ORACLES = {}, {}

#: Layers by kind: number of the group, channels, whether it is heard; the second group is one dB softer. Kind 0 has none, kind 4 names a channel twice.
GROUPS = {1: [("1, 2", 1)], 2: [("1", 1), ("2,3", 1)], 3: [("1,3", 1), ("2", 0)], 4: [("1,2", 1), ("2", 1)], 5: [("2", 0)]}
_rows = ", ".join(f"({kind}, {g}, {int(c)}, {len(named.split(','))}, {heard})" for kind, gs in GROUPS.items() for g, (named, heard) in enumerate(gs) for c in named.split(","))
#: A brand's project: its parts are a tree, each with three below it. A part with others below is a media; the first is used twice.
TREE = f"""
rk AS (SELECT substr(p_brand, 7)::INTEGER AS doc, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i, p_size AS size FROM part),
part_(doc, i, up, kind, db, chans, src, leaf) AS (SELECT doc, i, CASE WHEN i > 0 THEN (i - 1) // 3 END, CASE WHEN size % 13 = 7 THEN 4 WHEN size % 17 = 5 THEN 5 WHEN size % 4 = 0 THEN 2 WHEN size % 4 = 1 THEN 1 WHEN size % 4 = 2 AND i % 2 = 0 THEN 3 ELSE 0 END, -(size % 5),
    CASE WHEN i % 5 = 0 THEN 1 ELSE 1 + i % 3 END, CASE WHEN i % 5 = 0 THEN 2 ELSE 1 END, 3 * i + 1 >= count(*) OVER (PARTITION BY doc) FROM rk),
grp(kind, g, ch, n, heard) AS (VALUES {_rows})"""
SQL = f"""WITH RECURSIVE {TREE},
lay AS (SELECT kind, ch, max(n) AS n, max(g) AS g FROM grp WHERE heard = 1 AND kind <> 4 GROUP BY kind, ch),
w(doc, leaf, way, node, channel, here, db, divisor, bad, depth) AS (
    SELECT p.doc, p.i, way, p.i, c, c, 0, 1, false, 0 FROM part_ p, range(1, 4) r(c), (VALUES ('a'), ('b')) x(way) WHERE p.leaf AND c <= p.chans
    UNION ALL
    SELECT w.doc, w.leaf, w.way, p.up, w.channel, w.here + CASE WHEN p.leaf THEN (p.src - 1) * p.chans ELSE 0 END, w.db + CASE WHEN l.ch IS NULL THEN 0 ELSE p.db - l.g END, coalesce(l.n, w.divisor), w.bad OR p.kind = 4, depth + 1
    FROM w JOIN part_ p ON p.doc = w.doc AND p.i = w.node LEFT JOIN lay l ON l.kind = p.kind AND l.ch = w.here
    WHERE (p.kind IN (0, 4) OR l.ch IS NOT NULL) AND (p.i > 0 OR w.way = 'a')),
second AS (SELECT w.*, p.db AS own FROM w JOIN part_ p ON p.doc = w.doc AND p.i = 0 WHERE way = 'b' AND node = 0 AND w.leaf > 0 AND w.here <= 2),
done AS (SELECT doc, leaf, way, channel, db, divisor, bad, depth FROM w WHERE way = 'a' AND node IS NULL UNION ALL SELECT doc, leaf, way, channel, db - 2, 2, bad, depth + 1 FROM second)
SELECT doc, 'p' || leaf AS sound, CASE way WHEN 'a' THEN 'u0' ELSE 'again' END AS top, channel::INTEGER AS channel, depth::INTEGER AS clips, CASE WHEN NOT bad THEN db::DOUBLE END AS db, CASE WHEN NOT bad THEN divisor::INTEGER END AS divisor,
       CASE WHEN NOT bad THEN pow(10.0::DOUBLE, db / 20.0::DOUBLE) / divisor END AS weight, CASE WHEN bad THEN 'channels' END AS reason FROM done"""


def written_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of project files, one for each brand, written to the shared folder and read again."""
    parts = table(spark, sf_dir, "part").select(F.regexp_extract("p_brand", "([0-9]+)$", 1).cast("int").alias("doc"), "p_partkey", F.col("p_size").alias("size"))
    by = Window.partitionBy("doc")
    p = parts.withColumn("i", F.row_number().over(by.orderBy("p_partkey")) - 1).withColumn("all", F.count(F.lit(1)).over(by))
    i, size = F.col("i"), F.col("size")
    kind = F.when(size % 13 == 7, 4).when(size % 17 == 5, 5).when(size % 4 == 0, 2).when(size % 4 == 1, 1).when((size % 4 == 2) & (i % 2 == 0), 3).otherwise(0)
    leaf = 3 * i + 1 >= F.col("all")
    layer = F.lit("")
    for k, groups in GROUPS.items():
        told = [F.concat(F.lit(f'<audio-channel-source srcCh="{named}" active="{heard}"><adjust-volume amount="'), (-(size % 5) - g).cast("string"), F.lit('dB"/></audio-channel-source>')) for g, (named, heard) in enumerate(groups)]
        layer = F.when(kind == k, F.concat(*told)).otherwise(layer)
    sound = F.concat(F.when(i % 5 == 0, F.concat(F.lit('<audio ref="a1" srcID="2" name="p'))).otherwise(F.concat(F.lit('<asset-clip ref="a'), (1 + i % 3).cast("string"), F.lit('" name="p'))), i.cast("string"), F.lit('">'), layer, F.when(i % 5 == 0, "</audio>").otherwise("</asset-clip>"))
    use = F.when(leaf, sound).otherwise(F.concat(F.lit('<ref-clip ref="m'), i.cast("string"), F.lit('" name="u'), i.cast("string"), F.lit('">'), layer, F.lit("</ref-clip>")))
    uses = p.select("doc", "i", F.floor((i - 1) / 3).cast("int").alias("up"), leaf.alias("leaf"), use.alias("x"))
    inside = lambda *keys: uses.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda r: r["x"]), "").alias("x"))
    media = inside("doc", "up").where("up >= 0").select("doc", F.concat(F.lit('<media id="m'), F.col("up").cast("string"), F.lit('"><sequence><spine>'), "x", F.lit("</spine></sequence></media>")).alias("m"))
    top = uses.where("i = 0").select("doc", F.col("x").alias("first"), "leaf")
    again = F.when(F.col("leaf"), "").otherwise('<ref-clip ref="m0" name="again"><audio-channel-source srcCh="1,2"><adjust-volume amount="-2dB"/></audio-channel-source></ref-clip>')
    text = F.concat(F.lit('<fcpxml><resources><asset id="a1"/><asset id="a2" audioChannels="2"/><asset id="a3" audioChannels="3"/>'), F.coalesce("m", F.lit("")), F.lit('</resources><project uid="p"><sequence><spine>'), "first", again, F.lit("</spine></sequence></project></fcpxml>"))
    docs = top.join(media.groupBy("doc").agg(F.array_join(F.array_sort(F.collect_list("m")), "").alias("m")), "doc", "left")
    where = folder(spark, "layers")
    docs.select("doc", text.alias("value")).repartition("doc").write.partitionBy("doc").text(where)
    return N.read_nodes(spark, where).withColumn("doc", F.regexp_extract("doc", r"doc=([0-9]+)/", 1).cast("int"))


def rec1_mat7_channel_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each channel of each use of a sound counts for, through all the layers above it."""
    nodes = written_layers(spark, sf_dir)
    named = nodes.select("doc", "id", F.try_element_at("attrs", F.lit("name")).alias("name"))
    w = C.weights(nodes).withColumn("last", F.try_element_at("path", F.lit(-1)))
    w = w.join(named.select("doc", F.col("id").alias("sound"), F.col("name").alias("of")), ["doc", "sound"]).join(named.select("doc", F.col("id").alias("last"), F.col("name").alias("top")), ["doc", "last"], "left")
    return w.select("doc", F.col("of").alias("sound"), "top", "channel", (F.size("path") + 1).alias("clips"), "db", "divisor", "weight", "reason")


QUERIES["rec1_mat7_channel_layers"] = rec1_mat7_channel_layers
ORACLES["rec1_mat7_channel_layers"] = SQL
