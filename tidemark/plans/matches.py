"""Queries over look-ups, matches, aggregates, picks and set logic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import gains as A
from tidemark.functions import rational as R
from tidemark.operators import lookups as L
from tidemark.plans.derive import CLIPS, INTERVALS, WORDS, clips, intervals, table, words

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):  # noqa: ANN201
    def register(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


@query(f"WITH {CLIPS} SELECT doc, ord, asset, p_brand AS brand, p_brand IS NOT NULL AS found FROM clip LEFT JOIN part ON p_partkey = asset AND p_size > 10")
def join1_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    dim = table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("asset"), F.col("p_brand").alias("brand"))
    return L.looked_up(clips(spark, sf_dir).select("doc", "ord", "asset"), dim, "asset")


@query("SELECT c_mktsegment AS k, arg_max(c_name, c_custkey) AS name, max(c_custkey) AS o FROM customer GROUP BY 1")
def d2_last_duplicate_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.last_of(table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("k"), F.col("c_name").alias("name"), F.col("c_custkey").alias("o")), "k", "o")


@query(f"WITH {CLIPS} SELECT doc, ord, coalesce(CASE WHEN p_size % 3 = 0 THEN p_size END, 25)::BIGINT AS fps FROM clip LEFT JOIN part ON p_partkey = asset")
def join2_inherited_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    dim = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("asset"), F.when(F.col("p_size") % 3 == 0, F.col("p_size")).alias("fps"))
    return L.looked_up(clips(spark, sf_dir), dim, "asset").select("doc", "ord", F.coalesce("fps", F.lit(25)).cast("long").alias("fps"))


@query(f"WITH {CLIPS}, a AS (SELECT doc, effect, count(*) AS n, min(ord) AS ord2 FROM clip GROUP BY doc, effect) SELECT c.doc, c.ord, a.ord2, n = 1 AS unique_angle FROM clip c JOIN a USING (doc, effect)")
def join4_angle_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = clips(spark, sf_dir)
    a = c.groupBy("doc", "effect").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("ord2"))
    return c.join(a, ["doc", "effect"]).select("doc", "ord", "ord2", (F.col("n") == 1).alias("unique_angle"))


ROLES = "st AS (SELECT * FROM (VALUES ('dialogue', 1), ('dialogue.f', 2), ('music', 3), ('effects.o', 4)) v(role2, gain))"


@query(f"WITH {CLIPS}, {ROLES} SELECT doc, ord, role AS name, arg_max(gain, length(role2)) AS gain, arg_max(role2, length(role2)) AS setting FROM clip LEFT JOIN st ON role = role2 OR starts_with(role, role2 || '.') GROUP BY doc, ord, role")
def join5_ord7_longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = spark.createDataFrame([("dialogue", 1), ("dialogue.f", 2), ("music", 3), ("effects.o", 4)], "role string, gain int")
    return L.longest_prefix(clips(spark, sf_dir).select("doc", "ord", F.col("role").alias("name")), settings)


TOKENS = """
dt0 AS (SELECT doc_id AS doc, list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: x <> '') AS l FROM documents),
dt AS (SELECT doc, unnest(l) AS k, generate_subscripts(l, 1) - 1 AS pos FROM dt0),
bt0 AS (SELECT item_id AS item, list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: x <> '') AS l FROM benchmark),
bt AS (SELECT item, unnest(l) AS k, generate_subscripts(l, 1) - 1 AS pos FROM bt0),
dg AS (SELECT * FROM (SELECT doc, pos AS a1, k AS k1, lead(k, 1) OVER w AS k2, lead(k, 2) OVER w AS k3 FROM dt WINDOW w AS (PARTITION BY doc ORDER BY pos)) WHERE k3 IS NOT NULL),
bg AS (SELECT * FROM (SELECT item, pos AS at2, k AS k1, lead(k, 1) OVER w AS k2, lead(k, 2) OVER w AS k3 FROM bt WINDOW w AS (PARTITION BY item ORDER BY pos)) WHERE k3 IS NOT NULL),
ok AS (SELECT k1, k2, k3 FROM bg GROUP BY ALL HAVING count(*) <= 40),
mt AS (SELECT dg.*, item, at2 FROM dg JOIN (SELECT bg.* FROM bg JOIN ok USING (k1, k2, k3)) USING (k1, k2, k3))
"""


def _tokens(df: DataFrame, key: str, name: str) -> DataFrame:
    return df.select(F.col(key).alias(name), F.posexplode(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: x != "")).alias("pos", "k"))


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = L.grams(_tokens(table(spark, sf_dir, "documents"), "doc_id", "doc"), ["doc"], "pos", "k")
    b = L.grams(_tokens(table(spark, sf_dir, "benchmark"), "item_id", "item"), ["item"], "pos", "k")
    return L.retrieved(d, b)


@query(f"WITH {TOKENS} SELECT doc, item, a1::BIGINT AS pos, at2::BIGINT AS pos2 FROM mt")
def join12_inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark, sf_dir).select("doc", "item", F.col("at").cast("long").alias("pos"), F.col("at2").cast("long").alias("pos2"))


@query(f"WITH {TOKENS}, v AS (SELECT doc, item, at2 - a1 AS off, count(*) AS votes, min((a1, at2)) AS met FROM mt GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc, item ORDER BY votes DESC, met) AS rank FROM v) SELECT doc, item, off::BIGINT AS off, votes, rank FROM r WHERE rank <= 8")
def agg6_ord4_offset_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = L.voted(matches(spark, sf_dir), ["doc", "item"])
    return v.select("doc", "item", F.col("off").cast("long").alias("off"), "votes", "rank")


LAYOUT = "o AS (SELECT ps AS doc, list_transform(range(0, 2 + ps % 3), lambda i: (i * 2 + ps) % 7) AS channels, (1 + ps % 4)::DOUBLE AS gain FROM (SELECT p_partkey AS ps FROM part)), n AS (SELECT p_partkey AS doc, list_transform(range(0, 3), lambda i: (i + p_partkey) % 5) AS channels FROM part)"


@query(f"WITH {LAYOUT}, a AS (SELECT doc, gain / len(channels) AS share, unnest(channels) AS channel FROM o), b AS (SELECT doc, unnest(channels) AS channel FROM n) SELECT a.doc, a.channel::BIGINT AS channel, share FROM a JOIN b USING (doc, channel)")
def join14_channel_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc"))
    seq = lambda n, f: F.transform(F.sequence(F.lit(0).cast("long"), n - 1), f)
    outer = p.select("doc", seq(F.lit(2) + F.col("doc") % 3, lambda i: (i * 2 + F.col("doc")) % 7).alias("channels"), (1 + F.col("doc") % 4).cast("double").alias("gain"))
    inner = p.select("doc", seq(F.lit(3).cast("long"), lambda i: (i + F.col("doc")) % 5).alias("channels"))
    return L.channel_overlap(outer, inner, ["doc"]).select("doc", "channel", "share")


KEYFRAMES = INTERVALS + """, kf AS (SELECT u, b // 3600000000 AS a1, max(e - b) // 1000 AS value FROM iv GROUP BY ALL),
pt AS (SELECT DISTINCT u, b // 1800000000 AS h FROM iv), seg AS (SELECT *, lead(a1) OVER w AS at2, lead(value) OVER w AS value2, row_number() OVER w = 1 AS first FROM kf WINDOW w AS (PARTITION BY u ORDER BY a1))"""


@query(f"WITH {KEYFRAMES} SELECT pt.u, h, CASE WHEN h / 2.0 - 1 <= a1 OR at2 IS NULL THEN value::DOUBLE ELSE value + (value2 - value) * ((h / 2.0 - 1 - a1) / (at2 - a1)) END AS value FROM pt JOIN seg ON pt.u = seg.u AND (h / 2.0 - 1 >= a1 OR first) AND (at2 IS NULL OR h / 2.0 - 1 < at2)")
def join16_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    iv = intervals(spark, sf_dir)
    hour = lambda n: R.floor_div(F.col("b"), F.lit(n))
    frames = iv.groupBy("u", hour(3_600_000_000).alias("at")).agg(R.floor_div(F.max(F.col("e") - F.col("b")), F.lit(1000)).alias("value"))
    points = iv.select("u", hour(1_800_000_000).alias("h")).distinct().withColumn("t", F.col("h") / 2.0 - 1)
    return L.interpolated(points.select("u", "t"), frames, ["u"]).select("u", ((F.col("t") + 1) * 2).cast("long").alias("h"), "value")


REQUESTS = "rq AS (SELECT event_id AS id, user_id AS uid, CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_type END AS model FROM events), rs AS (SELECT event_id AS id, CASE WHEN event_id % 11 = 0 THEN -1 ELSE user_id END AS uid, CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_type END AS model, value FROM events)"


@query(f"WITH {REQUESTS} SELECT rq.id, rs.value FROM rq JOIN rs ON rq.id = rs.id AND rq.uid = rs.uid AND rq.model IS NOT DISTINCT FROM rs.model")
def join17_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    model = F.when(F.col("event_id") % 9 != 0, F.col("event_type"))
    rq = ev.select(F.col("event_id").alias("id"), F.col("user_id").alias("uid"), model.alias("model"))
    rs = ev.select(F.col("event_id").alias("id2"), F.when(F.col("event_id") % 11 == 0, -1).otherwise(F.col("user_id")).alias("uid2"), model.alias("model2"), "value")
    return rq.join(rs, (F.col("id") == F.col("id2")) & (F.col("uid") == F.col("uid2")) & F.col("model").eqNullSafe(F.col("model2"))).select("id", "value")


@query(f"WITH {CLIPS}, b AS (SELECT doc, ord, off, CASE WHEN doc % 13 = 0 AND ord = 1 THEN len + 1 ELSE len END AS len FROM clip WHERE NOT (doc % 17 = 0 AND ord = 2)) SELECT doc, bool_and(a.off IS NOT DISTINCT FROM b.off AND a.len IS NOT DISTINCT FROM b.len) AS same FROM clip a FULL JOIN b USING (doc, ord) GROUP BY doc")
def join18_row_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = clips(spark, sf_dir).select("doc", "ord", "off", "len")
    b = a.where("NOT (doc % 17 = 0 AND ord = 2)").select("doc", "ord", F.col("off").alias("off2"), F.when((F.col("doc") % 13 == 0) & (F.col("ord") == 1), F.col("len") + 1).otherwise(F.col("len")).alias("len2"))
    return a.join(b, ["doc", "ord"], "full_outer").groupBy("doc").agg(F.every(F.col("off").eqNullSafe(F.col("off2")) & F.col("len").eqNullSafe(F.col("len2"))).alias("same"))


@query("SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events WHERE value > 20 GROUP BY ALL")
def join19_ord8_cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").withColumn("o", F.struct("ts", "event_id"))
    return L.newest_valid(ev, ["user_id", "event_type"], F.col("value") > 20, "o", "event_id").select("user_id", "event_type", "event_id", F.col("o.ts").alias("ts"))


@query(f"WITH {CLIPS} SELECT doc, string_agg(role, '|' ORDER BY ord) AS roles FROM clip GROUP BY doc")
def agg7_roles_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clips(spark, sf_dir).groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "role"))), lambda x: x["role"]), "|").alias("roles"))


@query(f"WITH {CLIPS}, f AS (SELECT doc, role, min(ord) AS o FROM clip GROUP BY ALL) SELECT doc, string_agg(role, '|' ORDER BY o) AS roles FROM f GROUP BY doc")
def agg8_set4_ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.ordered_distinct(clips(spark, sf_dir), ["doc"], "role", "ord").select("doc", F.array_join("values", "|").alias("roles"))


@query(f"WITH {CLIPS} SELECT doc, count(*) AS n, count(*) FILTER (split_part(role, '.', 1) IN ('music', 'effects')) AS ignored, count(*) FILTER (disc = 0) AS bypassed, count(*) - least(count(*), 3) AS omitted, count(DISTINCT effect) AS effects, count(DISTINCT disc) <= 1 AS one_gain FROM clip GROUP BY doc")
def agg13_agg14_agg17_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count(F.lit(1))
    return clips(spark, sf_dir).groupBy("doc").agg(n.alias("n"), F.count_if(F.split_part("role", F.lit("."), F.lit(1)).isin("music", "effects")).alias("ignored"), F.count_if(F.col("disc") == 0).alias("bypassed"), (n - F.least(n, F.lit(3))).alias("omitted"), F.count_distinct("effect").alias("effects"), (F.count_distinct("disc") <= 1).alias("one_gain"))


@query(f"WITH {CLIPS} SELECT doc, bool_or(n > 1) AS repeated, bool_and(role IN ('dialogue.o', 'dialogue.f', 'music.o', 'music.f', 'effects.o')) AS allowed FROM (SELECT doc, role, effect, count(*) AS n FROM clip GROUP BY ALL) GROUP BY doc")
def fil14_role_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = clips(spark, sf_dir).groupBy("doc", "role", "effect").agg(F.count(F.lit(1)).alias("n"))
    return g.groupBy("doc").agg(F.some(F.col("n") > 1).alias("repeated"), F.every(F.col("role").isin("dialogue.o", "dialogue.f", "music.o", "music.f", "effects.o")).alias("allowed"))


@query(f"WITH {CLIPS} SELECT doc, ord FROM clip WHERE NOT (split_part(role, '.', 1) IN ('music', 'effects'))")
def fil2_excluded_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clips(spark, sf_dir).where(~F.split_part("role", F.lit("."), F.lit(1)).isin("music", "effects")).select("doc", "ord")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_linestatus WHEN 'O' THEN true WHEN 'F' THEN false END AS flag FROM lineitem")
def fil1_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict: anything but the two written values is an error."""
    raw = F.when(F.col("l_linestatus") == "O", "1").when(F.col("l_linestatus") == "F", "0").otherwise(F.col("l_linestatus"))
    flag = F.when(raw == "1", True).when(raw == "0", False).otherwise(F.raise_error(F.concat(F.lit("not a flag: "), raw)).cast("boolean"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", flag.alias("flag"))


@query(f"WITH {CLIPS} SELECT doc, ord, disc < 9 AND len > 3 AND p_size > 5 AND tax <> 4 AND split_part(role, '.', 1) <> 'music' AS audible FROM clip JOIN part ON p_partkey = asset")
def fil4_audibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    dim = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("asset"), "p_size")
    ok = (F.col("disc") < 9) & (F.col("len") > 3) & (F.col("p_size") > 5) & (F.col("tax") != 4) & (F.split_part("role", F.lit("."), F.lit(1)) != "music")
    return clips(spark, sf_dir).join(dim, "asset").select("doc", "ord", ok.alias("audible"))


@query("SELECT event_id, list_sort(list_filter(json_keys(props), lambda x: NOT list_contains(['page', 'k'], x))) AS unknown FROM events")
def fil7_set2_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = F.json_object_keys("props")
    return table(spark, sf_dir, "events").select("event_id", F.array_sort(F.array_except(keys, F.array(F.lit("page"), F.lit("k")))).alias("unknown"))


@query(f"WITH {CLIPS} SELECT doc, count(*) FILTER (s_suppkey IS NULL) AS missing, count(*) FILTER (s_acctbal > 1000) AS enabled FROM clip LEFT JOIN supplier ON s_suppkey = effect AND s_nationkey <> 3 GROUP BY doc")
def fil19_effect_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    dim = table(spark, sf_dir, "supplier").where("s_nationkey <> 3").select(F.col("s_suppkey").alias("effect"), "s_acctbal")
    return L.looked_up(clips(spark, sf_dir), dim, "effect").groupBy("doc").agg(F.count_if(~F.col("found")).alias("missing"), F.count_if(F.col("s_acctbal") > 1000).alias("enabled"))


@query(f"WITH {CLIPS} SELECT doc, ord, off, len FROM clip WHERE disc > 5 AND role LIKE 'music%'")
def fil24_removed_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clips(spark, sf_dir).where((F.col("disc") > 5) & F.col("role").startswith("music")).select("doc", "ord", "off", "len")


@query(f"WITH {WORDS}, s AS (SELECT doc, count(*) AS n, min(start_ms) AS b, max(end_ms) AS e FROM word GROUP BY doc) SELECT doc, n, row_number() OVER (ORDER BY b, e, doc) AS rank, row_number() OVER (ORDER BY b, e, doc) <= 64 AS kept FROM s")
def ord1_ord10_span_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order of documents by span; the ranked rows are one for each document, and the first 64 are within the cap."""
    s = words(spark, sf_dir).groupBy("doc").agg(F.count(F.lit(1)).alias("n"), F.min("start_ms").alias("b"), F.max("end_ms").alias("e"))
    return L.ranked(s, ["b", "e", "doc"]).select("doc", "n", "rank", (F.col("rank") <= 64).alias("kept"))


@query("SELECT arg_min(conv_id, (text, conv_id)) AS first, min(text) AS text FROM conversations")
def ord9_queue_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").agg(F.min(F.struct("text", "conv_id")).alias("m")).select(F.col("m.conv_id").alias("first"), F.col("m.text").alias("text"))


@query(f"WITH {CLIPS} SELECT doc, ord, 'clip' AS branch FROM clip UNION ALL SELECT p_partkey, p_size, 'asset' FROM part")
def set1_union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = clips(spark, sf_dir).select("doc", "ord", F.lit("clip").alias("branch"))
    return a.unionByName(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc"), F.col("p_size").cast("long").alias("ord"), F.lit("asset").alias("branch")))


@query(f"WITH {LAYOUT} SELECT doc, list_has_any(o.channels, n.channels) AS shared, len(list_distinct(list_filter(o.channels, lambda x: list_contains(n.channels, x))))::INTEGER AS n FROM o JOIN n USING (doc)")
def set3_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = lambda n, f: F.transform(F.sequence(F.lit(0).cast("long"), n - 1), f)
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc"))
    both = p.select("doc", seq(F.lit(2) + F.col("doc") % 3, lambda i: (i * 2 + F.col("doc")) % 7).alias("a"), seq(F.lit(3).cast("long"), lambda i: (i + F.col("doc")) % 5).alias("b"))
    return both.select("doc", F.arrays_overlap("a", "b").alias("shared"), F.size(F.array_intersect("a", "b")).alias("n"))


CHANNELS = "c AS (SELECT p_partkey AS doc, p_size || ',' || (p_size + 1) || CASE WHEN p_partkey % 5 = 0 THEN ',' || p_size ELSE '' END || CASE WHEN p_partkey % 7 = 0 THEN ',x' ELSE '' END AS text FROM part)"


@query(f"WITH {CHANNELS}, l AS (SELECT doc, string_split(text, ',') AS l, regexp_matches(text, '^[0-9]+(,[0-9]+)*$') AS f FROM c) SELECT doc, f AND len(l) <= 64 AND len(l) = len(list_distinct(l)) AS ok, CASE WHEN f THEN list_transform(l, lambda x: x::BIGINT) END AS channels FROM l")
def arr1_channel_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    text = F.concat(size, F.lit(","), (F.col("p_size") + 1).cast("string"), F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit(","), size)).otherwise(""), F.when(F.col("p_partkey") % 7 == 0, ",x").otherwise(""))
    c = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc"), F.split(text, ",").alias("l"), F.rlike(text, F.lit("^[0-9]+(,[0-9]+)*$")).alias("f"))
    ok = F.col("f") & (F.size("l") <= 64) & (F.size("l") == F.size(F.array_distinct("l")))
    return c.select("doc", ok.alias("ok"), F.when(F.col("f"), F.transform("l", lambda x: x.try_cast("long"))).alias("channels"))


@query(f"WITH {LAYOUT} SELECT doc, list_transform(list_filter(channels, lambda x: x // 2 = doc % 3), lambda x: x - doc % 3 * 2) AS own, len(channels)::INTEGER AS divisor FROM o")
def arr2_source_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc"))
    c = p.select("doc", F.transform(F.sequence(F.lit(0).cast("long"), F.lit(1) + F.col("doc") % 3), lambda i: (i * 2 + F.col("doc")) % 7).alias("channels"))
    source = F.col("doc") % 3
    return c.select("doc", F.transform(F.filter("channels", lambda x: (x - x % 2) == source * 2), lambda x: x - source * 2).alias("own"), F.size("channels").alias("divisor"))


@query(f"WITH {CLIPS} SELECT doc, string_agg(ord || '=' || role, ',' ORDER BY ord) AS roles FROM clip GROUP BY doc")
def arr3_channel_role_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = clips(spark, sf_dir).groupBy("doc").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("ord", "role")))).alias("m"))
    return m.select("doc", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"])), ",").alias("roles"))


def shown(num: str, den: str) -> str:
    """A reduced fraction as text, in SQL."""
    return f"CASE WHEN {num} % {den} = 0 THEN ({num} // {den})::VARCHAR ELSE ({num} // gcd({num}, {den})) || '/' || ({den} // gcd({num}, {den})) END"


@query(f"""WITH {CLIPS} SELECT doc, ord, CASE WHEN tax <> 4 THEN {shown('len', '(disc + 1)')} END AS length, CASE WHEN tax <> 4 THEN {shown('off', '6')} END AS shift, CASE WHEN tax <> 4 THEN disc % 3 END AS keys,
CASE WHEN tax <> 4 AND disc % 3 > 0 THEN {shown('(disc % 3 * len)', '8')} END AS last, CASE WHEN tax <> 4 AND disc % 3 > 0 THEN (disc % 3 - 9)::DOUBLE END AS db FROM clip""")
def jsn1_envelope_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelopes through JSON and back, their rationals exact; one with a field that nobody knows is refused."""
    c = clips(spark, sf_dir)
    n = (F.col("disc") % 3).cast("int")
    key = lambda i: F.struct(R.rational(i * F.col("len"), F.lit(8)).alias("time"), (i - 9).alias("db"))
    keys = F.transform(F.filter(F.sequence(F.lit(1).cast("long"), F.lit(2).cast("long")), lambda i: i <= n), key)
    body = A.packed(R.rational(F.lit(1).cast("long"), F.lit(2)), R.rational(F.col("off"), F.lit(6)), R.rational(F.col("len"), F.col("disc") + 1), F.col("disc") / 10.0, keys)
    body = F.when(F.col("tax") == 4, F.replace(body, F.lit('"base_db"'), F.lit('"colour"'))).otherwise(body)
    # Generators keep what they make from being written out again in every use.
    told = c.select("doc", "ord", F.explode(F.array(body)).alias("body"))
    e = told.select("doc", "ord", F.explode(F.array(A.unpacked(F.col("body")))).alias("e"))
    last = F.try_element_at("e.keys", F.lit(-1))
    text = lambda c: A.once(c, lambda r: F.when(r.isNotNull(), R.show(r)))
    return e.select("doc", "ord", text(F.col("e.length")).alias("length"), text(F.col("e.shift")).alias("shift"), F.when(F.col("e").isNotNull(), F.size("e.keys")).cast("long").alias("keys"), text(last["time"]).alias("last"), last["db"].alias("db"))


@query(f"WITH {CLIPS} SELECT doc, count(*) AS segments, sum(len)::BIGINT AS total, sha256(string_agg(asset::VARCHAR, ',' ORDER BY ord)) AS sha FROM clip GROUP BY doc")
def jsn2_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    assets = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "asset"))), lambda x: x["asset"].cast("string")), ",")
    m = clips(spark, sf_dir).groupBy("doc").agg(F.count(F.lit(1)).alias("segments"), F.sum("len").alias("total"), F.sha2(assets, 256).alias("sha"))
    packed = m.select("doc", F.to_json(F.struct("segments", "total", "sha")).alias("j"))
    return packed.select("doc", F.from_json("j", "segments long, total long, sha string").alias("m")).select("doc", "m.*")


SPEED = "CASE WHEN a = b THEN '1/1' WHEN a = 2997 AND b = 30 THEN '1001/1000' WHEN a = 60 AND b = 2997 THEN '2/1' ELSE 'refused' END"


@query(f"WITH r AS (SELECT p_partkey, [24, 30, 2997, 60][1 + p_size % 4] AS a, [24, 30, 2997, 60][1 + p_size // 4 % 4] AS b FROM part) SELECT p_partkey, {SPEED} AS speed FROM r")
def tim5_rate_conform(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = F.array(*[F.lit(x) for x in (24, 30, 2997, 60)])
    r = table(spark, sf_dir, "part").select("p_partkey", F.get(rates, F.col("p_size") % 4).alias("a"), F.get(rates, F.floor(F.col("p_size") / 4).cast("int") % 4).alias("b"))
    return r.select("p_partkey", F.when(F.col("a") == F.col("b"), "1/1").when((F.col("a") == 2997) & (F.col("b") == 30), "1001/1000").when((F.col("a") == 60) & (F.col("b") == 2997), "2/1").otherwise("refused").alias("speed"))


@query("SELECT event_id, epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) IS NOT NULL AND epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) < 10000000 AS fresh FROM events")
def tim8_heartbeat_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    before = F.lag(at).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(at - before < 10_000_000, F.lit(False)).alias("fresh"))


SHARES = "f AS (SELECT c_custkey // 3 AS share, c_name || ['.fcpxml', '.wav', '.txt', '.M4A'][1 + c_nationkey % 4] AS path FROM customer)"


@query(f"""WITH {SHARES}, k AS (SELECT *, CASE WHEN regexp_matches(lower(path), '\\.(fcpxml|xml)$') THEN 'xml' WHEN regexp_matches(lower(path), '\\.(wav|aif|aiff|m4a|mp3|caf)$') THEN 'audio' END AS kind FROM f)
SELECT share, max(path) FILTER (kind = 'xml') AS xml, max(path) FILTER (kind = 'audio') AS audio FROM k GROUP BY share HAVING count(*) FILTER (kind = 'xml') = 1 AND count(*) FILTER (kind = 'audio') = 1""")
def src19_paired_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of three files each: those with one project and one sound are taken, other files are not minded."""
    c = table(spark, sf_dir, "customer")
    suffix = F.get(F.array(*map(F.lit, (".fcpxml", ".wav", ".txt", ".M4A"))), (F.col("c_nationkey") % 4).cast("int"))
    return L.paired(c.select(F.floor(F.col("c_custkey") / 3).cast("long").alias("share"), F.concat("c_name", suffix).alias("path")), "share")
