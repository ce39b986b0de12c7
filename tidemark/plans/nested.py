"""Queries over nested timelines and node tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.plans.derive import CLIPS, clips, table
from tidemark.shared import folder
from tidemark.sources import timeline as N

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):  # noqa: ANN201
    def register(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


#: A tree over nations: region -> nation -> customer; and uses: an order shows its clips' suppliers, and those their nations.
TREE = """
nd AS (SELECT 'r' AS doc, r_regionkey::BIGINT AS id, NULL::BIGINT AS parent FROM region UNION ALL SELECT 'r', 1000 + n_nationkey, n_regionkey FROM nation UNION ALL SELECT 'r', 100000 + c_custkey, 1000 + c_nationkey FROM customer)
"""
USES = CLIPS + """,
us AS (SELECT doc, NULL::BIGINT AS media, effect AS ref, off, disc AS start, len, effect % 4 = 0 AS leaf, 1 + effect % 2 AS stretch, tax <> 3 AS enabled, 1 + tax AS gain, role FROM clip
 UNION ALL SELECT DISTINCT doc, effect, 100000 + effect % 7, effect % 5, 0, 20, effect % 2 = 0, 1, effect % 5 <> 0, 2, NULL FROM clip WHERE effect % 4 <> 0
 UNION ALL SELECT DISTINCT doc, 100000 + effect % 7, 200000 + effect % 3, 2, 1, 9, true, 3, true, 3, CASE WHEN effect % 3 = 0 THEN 'low' END FROM clip WHERE effect % 4 <> 0)
"""


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.lit("r").alias("doc")
    regions = table(spark, sf_dir, "region").select(doc, F.col("r_regionkey").cast("long").alias("id"), F.lit(None).cast("long").alias("parent"))
    nations = table(spark, sf_dir, "nation").select(doc, (F.lit(1000).cast("long") + F.col("n_nationkey")).alias("id"), F.col("n_regionkey").cast("long").alias("parent"))
    people = table(spark, sf_dir, "customer").select(doc, (F.lit(100000) + F.col("c_custkey")).alias("id"), (F.lit(1000).cast("long") + F.col("c_nationkey")).alias("parent"))
    return regions.unionByName(nations).unionByName(people)


def uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = clips(spark, sf_dir)
    none, one = F.lit(None).cast("long"), F.lit(1).cast("long")
    top = c.select("doc", none.alias("media"), F.col("effect").alias("ref"), "off", F.col("disc").alias("start"), "len", (F.col("effect") % 4 == 0).alias("leaf"), (1 + F.col("effect") % 2).alias("stretch"), (F.col("tax") != 3).alias("enabled"), (1 + F.col("tax")).alias("gain"), "role")
    inner = c.where("effect % 4 <> 0")
    mid = inner.select("doc", F.col("effect").alias("media"), (F.lit(100000) + F.col("effect") % 7).alias("ref"), (F.col("effect") % 5).alias("off"), F.lit(0).cast("long").alias("start"), F.lit(20).cast("long").alias("len"), (F.col("effect") % 2 == 0).alias("leaf"), one.alias("stretch"), (F.col("effect") % 5 != 0).alias("enabled"), (one * 2).alias("gain"), F.lit(None).cast("string").alias("role")).distinct()
    low = inner.select("doc", (F.lit(100000) + F.col("effect") % 7).alias("media"), (F.lit(200000) + F.col("effect") % 3).alias("ref"), F.lit(2).cast("long").alias("off"), F.lit(1).cast("long").alias("start"), F.lit(9).cast("long").alias("len"), F.lit(True).alias("leaf"), (one * 3).alias("stretch"), F.lit(True).alias("enabled"), (one * 3).alias("gain"), F.when(F.col("effect") % 3 == 0, "low").alias("role")).distinct()
    return top.unionByName(mid).unionByName(low)


@query(f"WITH RECURSIVE {TREE}, c(ancestor, id, depth) AS (SELECT id, id, 0 FROM nd UNION ALL SELECT c.ancestor, n.id, c.depth + 1 FROM c JOIN nd n ON n.parent = c.id) SELECT ancestor, id, depth FROM c")
def rec1_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.closure(tree(spark, sf_dir)).select("ancestor", "id", "depth")


@query(f"WITH RECURSIVE {TREE}, u(id, up) AS (SELECT id, parent FROM nd JOIN customer ON id = 100000 + c_custkey WHERE c_acctbal < 0 UNION SELECT n.id, n.parent FROM u JOIN nd n ON n.id = u.up) SELECT DISTINCT id FROM u")
def fil5_fil6_subtree_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tree(spark, sf_dir)
    return N.subtree_exists(t, table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.lit("r").alias("doc"), (F.lit(100000) + F.col("c_custkey")).alias("id"))).select("id")


@query(f"""WITH RECURSIVE {USES}, w(doc, ref, leaf, origin, start, b, e, depth, clock, enabled, gain, role) AS (SELECT doc, ref, leaf, off, start, off, off + len * stretch, 0, stretch, enabled, gain, role FROM us WHERE media IS NULL
UNION ALL SELECT doc, ur, ul, o, us_, greatest(b, o), least(e, o + clock * k * n), depth + 1, clock * k, on_, g, r FROM (SELECT w.doc, u.ref AS ur, u.leaf AS ul, w.origin + w.clock * (u.off - w.start) AS o, u.start AS us_, w.b, w.e, w.clock, u.stretch AS k, u.len AS n, w.depth, w.enabled AND u.enabled AS on_, w.gain * u.gain AS g, coalesce(u.role, w.role) AS r
  FROM w JOIN us u ON u.doc = w.doc AND u.media = w.ref WHERE NOT w.leaf) WHERE greatest(b, o) < least(e, o + clock * k * n))
SELECT doc, ref, b, e, b - origin + clock * start AS source, clock, depth, enabled, gain, role FROM w WHERE leaf""")
def rec1_rec2_join3_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.expanded(uses(spark, sf_dir)).where("reason IS NULL").drop("reason", "frame")


@query(f"WITH {TREE} SELECT p.id, count(*) AS children, count(*) FILTER (c.id % 3 = 0) AS audio FROM nd c JOIN nd p ON c.parent = p.id GROUP BY p.id")
def fil12_source_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tree(spark, sf_dir)
    pairs = t.select(F.col("id").alias("child"), F.col("parent").alias("up")).join(t.select("id"), F.col("up") == F.col("id"))
    return pairs.groupBy("id").agg(F.count(F.lit(1)).alias("children"), F.count_if(F.col("child") % 3 == 0).alias("audio"))


#: Suppliers of a nation as the clips of a project: some at another rate, with a strange attribute, or a hole.
FILES = """su AS (SELECT s_nationkey AS doc, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS ord, s_name AS name, (s_suppkey % 7 + 1)::BIGINT AS n FROM supplier),
cl AS (SELECT *, (coalesce(sum(n) OVER (PARTITION BY doc ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + CASE WHEN doc % 5 = 2 AND ord = 1 THEN 1 ELSE 0 END)::BIGINT AS a FROM su)"""


def written_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of project files, one for each nation, written to the shared folder and read again."""
    w = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    su = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("doc"), (F.row_number().over(w) - 1).alias("ord"), "s_suppkey", F.col("s_name").alias("name"), (F.col("s_suppkey") % 7 + 1).cast("long").alias("n"))
    before = Window.partitionBy("doc").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    cl = su.withColumn("a", F.coalesce(F.sum("n").over(before), F.lit(0)) + F.when((F.col("doc") % 5 == 2) & (F.col("ord") == 1), 1).otherwise(0))
    strange = F.when((F.col("doc") % 7 == 3) & (F.col("ord") == 0), ' speed="2"').otherwise("")
    time = lambda c: F.concat(c.cast("string"), F.lit("/25s"))
    item = F.concat(F.lit('<clip name="'), "name", F.lit('" offset="'), time(F.col("a")), F.lit('" duration="'), time(F.col("n")), F.lit('"'), strange, F.lit("/>"))
    items = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", item.alias("x")))), lambda r: r["x"]), "")
    docs = cl.groupBy("doc").agg(items.alias("items"), F.sum("n").alias("total"))
    head = F.concat(F.lit('<fcpxml><resources><format id="r1" frameDuration="'), F.when(F.col("doc") % 4 == 1, "1/24s").otherwise("100/2500s"), F.lit('"/></resources><project uid="p'), F.col("doc").cast("string"), F.lit('"><sequence format="r1" duration="'), time(F.col("total")), F.lit('"><spine>'))
    where = folder(spark, "projects")
    docs.select("doc", F.concat(head, "items", F.lit("</spine></sequence></project></fcpxml>")).alias("value")).repartition("doc").write.partitionBy("doc").text(where)
    nodes = N.read_nodes(spark, where)
    return nodes.withColumn("doc", F.regexp_extract("doc", r"doc=([0-9]+)/", 1).cast("int"))


@query(f"WITH {FILES} SELECT doc, count(*) + 6 AS nodes, count(*) AS clips, 0::BIGINT AS refused, string_agg(name, ',' ORDER BY ord) AS names FROM cl GROUP BY doc")
def src1_xml_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of real files, in document order."""
    nodes = written_projects(spark, sf_dir)
    named = F.array_sort(F.collect_list(F.when(F.col("tag") == "clip", F.struct("ord", F.col("attrs")["name"].alias("x")))))
    return nodes.groupBy("doc").agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("tag") == "clip").alias("clips"), F.count_if(~F.col("ok")).alias("refused"), F.array_join(F.transform(named, lambda r: r["x"]), ",").alias("names"))


@query(f"WITH {CLIPS}, u AS (SELECT effect, count(*) AS uses FROM clip GROUP BY effect) SELECT s_suppkey, coalesce(uses, 0)::BIGINT AS uses, s_nationkey FROM supplier LEFT JOIN u ON effect = s_suppkey")
def agg14_shared_resource_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shared resource is normalised once and counted for each use."""
    u = clips(spark, sf_dir).groupBy(F.col("effect").alias("s_suppkey")).agg(F.count(F.lit(1)).alias("uses"))
    return table(spark, sf_dir, "supplier").join(u, "s_suppkey", "left").select("s_suppkey", F.coalesce("uses", F.lit(0)).cast("long").alias("uses"), "s_nationkey")


@query(f"WITH {FILES}, t AS (SELECT doc, sum(n)::BIGINT AS n FROM cl GROUP BY doc) SELECT doc, 'p' || doc AS uid, CASE WHEN n % 25 = 0 THEN (n // 25)::VARCHAR ELSE (n // gcd(n, 25)) || '/' || (25 // gcd(n, 25)) END AS duration, CASE WHEN doc % 4 = 1 THEN '1/24' ELSE '1/25' END AS frame, n <= 360000 AS allowed FROM t")
def src3_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.header(written_projects(spark, sf_dir))


@query(f"""WITH {FILES}, t AS (SELECT doc, count(*) AS clips, sum(n)::BIGINT AS frames FROM cl GROUP BY doc)
SELECT doc, clips, frames, CASE WHEN doc % 4 = 1 THEN 'frame' WHEN clips > 64 THEN 'clips' WHEN doc % 7 = 3 THEN 'attributes' WHEN doc % 5 = 2 AND clips > 1 THEN 'tiles' WHEN frames > 750 THEN 'length' END AS reason FROM t""")
def src4_strict_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.strict(written_projects(spark, sf_dir))


@query(f"WITH {FILES} SELECT doc, ord::INTEGER AS ord, a AS start_frame, a + n AS end_frame, name FROM cl")
def src5_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.read_back(written_projects(spark, sf_dir))
