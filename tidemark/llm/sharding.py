"""Sharding by rendezvous hashing: DataFrame functions only.

Each record goes to the shard with the least cost -ln(u) / weight, where u is a hash of (key, shard)
in (0, 1). A shard's cost for a key does not depend on the other shards, so a new shard takes records
into itself and moves none between the old ones. A key is hashed once; its hashes for the shards follow by arithmetic.

Defined results: a NULL key hashes as a fixed text of its own (all such rows share a shard); a NULL
text has 0 bytes and the CRC of nothing; repeated rows share a shard and get slots of their own; an
empty table gives an empty one; a very long text is one row like any other. Columns of the input other than key and text
pass through if asked for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, stored

SHARDS = 40
#: Rows that one window partition numbers, about; the number of partitions grows with the table.
ROWS_PER_GROUP = 10_000
#: A prime below which all hashes lie, so that products fit a BIGINT; and the multiplier that spreads shard numbers.
PRIME, SPREAD = 2**31 - 1, 40503 * 52127
RESULTS = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def key_hashes(key: str) -> tuple[Column, Column]:
    """Two hashes below PRIME of a key's text, from one MD5."""
    digest = F.md5(F.encode(F.coalesce(F.col(key).cast("string"), F.lit("null")), "UTF-8"))
    part = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long") % PRIME
    return part(1), part(9)


def rendezvous_cost(h: Column, g: Column, shard: Column, weight: Column | float = 1.0) -> Column:
    """-ln(u) / weight; u in (0, 1) is two rounds of squares modulo PRIME over a line in the shard's own direction."""
    spread = (shard + 1).cast("long") * SPREAD % PRIME
    line = (h * spread + g) % PRIME
    once = (line * line + h + spread) % PRIME
    return -F.log((((once * once + g) % PRIME).cast("double") + 0.5) / float(PRIME)) / weight


def best_shard(h: Column, g: Column, weights: Sequence[float]) -> Column:
    """STRUCT(cost, shard) of the cheapest of len(weights) shards; ties go to the lower number."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    return F.array_min(F.transform(F.sequence(F.lit(0), F.lit(len(weights) - 1)), lambda s: F.struct(rendezvous_cost(h, g, s, F.get(w, s)).alias("cost"), s.alias("shard"))))


def free_names(kept: Sequence[str], key: str) -> list[str]:
    """The kept columns' names; one that a result has gets source_ before it until no other column has it (names differ by more than case)."""
    taken = {c.lower() for c in (*RESULTS, key, *[c for c in kept if c not in RESULTS])}
    out = []
    for c in kept:
        if c in RESULTS:
            while c.lower() in taken:
                c = f"source_{c}"
            taken.add(c.lower())
        out.append(c)
    return out


def shard(docs: DataFrame, weights: Sequence[float] = (1.0,) * SHARDS, key: str = "doc_id", text: str = "text", grown_weight: float = 1.0, keep: Sequence[str] = ()) -> DataFrame:
    """key, size, text_crc32, law, shard, slot, grown_shard, then the columns of `keep`; one of those that has a name of the results is
    returned as source_<name>, with more of source_ before it where another column has that name.

    Every row is hashed once and written with its shard; counts and numbers are taken from what was written. Slots are numbered by
    (group, key, CRC, size) within a shard, where a group is a range of a hash of key and CRC: rows that repeat a key are
    split by their texts. A window numbers each (shard, group) by itself; the groups' offsets are running sums of counts.
    So no task orders a whole shard. The number of groups follows from the row count.
    """
    n = len(weights)
    kept = [c for c in keep if c != key]
    body = F.coalesce(F.encode(F.col(text), "UTF-8"), F.lit(b""))
    carried = [F.col(c).alias(f"_shard_kept_{i}") for i, c in enumerate(kept)]
    hashed = docs.select(F.col(key).alias("_shard_key"), *carried, F.octet_length(body).cast("long").alias("_shard_bytes"), F.crc32(body).alias("_shard_crc"), *[c.alias(f"_shard_h{i}") for i, c in enumerate(key_hashes(key))])
    h, g = F.col("_shard_h0"), F.col("_shard_h1")
    best = hashed.withColumn("_shard_best", best_shard(h, g, weights)).withColumn("_shard_new", rendezvous_cost(h, g, F.lit(n), float(grown_weight)))
    placed = stored(best.select("*", F.col("_shard_best.shard").alias("_shard_at"), F.when(F.col("_shard_new") < F.col("_shard_best.cost"), F.lit(n)).otherwise(F.col("_shard_best.shard")).alias("_shard_grown")).drop("_shard_best", "_shard_new"), "placed")
    groups = max(1, -(-placed.count() // (n * ROWS_PER_GROUP)))
    grouped = placed.withColumn("_shard_group", (F.col("_shard_h1") + F.col("_shard_crc")) % groups)
    sizes = grouped.groupBy("_shard_at", "_shard_group").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_shard_at").orderBy("_shard_group").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_shard_at", "_shard_group", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shard_offset"))
    within = Window.partitionBy("_shard_at", "_shard_group").orderBy(F.col("_shard_key").asc_nulls_first(), "_shard_crc", "_shard_bytes")
    numbered = grouped.withColumn("_shard_rank", F.row_number().over(within))
    return numbered.join(offsets, ["_shard_at", "_shard_group"]).select(
        F.col("_shard_key").alias(key),
        (F.col("_shard_bytes") + 16).alias("size"),
        F.col("_shard_crc").alias("text_crc32"),
        F.lit("key").alias("law"),
        F.col("_shard_at").cast("int").alias("shard"),
        (F.col("_shard_offset") + F.col("_shard_rank") - 1).cast("long").alias("slot"),
        F.col("_shard_grown").cast("int").alias("grown_shard"),
        *[F.col(f"_shard_kept_{i}").alias(c) for i, c in enumerate(free_names(kept, key))],
    )


def op3_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(read(spark, sf_dir, "documents"))


#: The same in SQL, CRC-32 and all; its table follows from the polynomial by rule.
ORACLE = f"""
WITH RECURSIVE crc_steps(i, k, v) AS (
    SELECT range, 0, range::BIGINT FROM range(256)
    UNION ALL
    SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM crc_steps WHERE k < 8
),
crc_table AS (SELECT list(v ORDER BY i) AS t FROM crc_steps WHERE k = 8),
docs AS (
    SELECT doc_id, coalesce(doc_id::VARCHAR, 'null') AS k, octet_length(encode(coalesce(text, ''))) AS n_bytes,
           xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)),
               lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS crc
    FROM documents, crc_table
),
hashed AS (SELECT DISTINCT k, ('0x' || substr(md5(k), 1, 8))::BIGINT % {PRIME} AS h, ('0x' || substr(md5(k), 9, 8))::BIGINT % {PRIME} AS g FROM docs),
lines AS (SELECT k, h, g, s.range AS shard, (s.range + 1) * {SPREAD} % {PRIME} AS spread FROM hashed, range({SHARDS + 1}) s),
once AS (SELECT *, ((h * spread + g) % {PRIME} * ((h * spread + g) % {PRIME}) + h + spread) % {PRIME} AS o FROM lines),
costs AS (SELECT k, g, shard, -ln((((o * o + g) % {PRIME})::DOUBLE + 0.5) / {float(PRIME)!r}) AS cost FROM once),
best AS (SELECT k, any_value(g) AS g, arg_min(shard, (cost, shard)) FILTER (shard < {SHARDS}) AS shard, arg_min(shard, (cost, shard)) AS grown_shard FROM costs GROUP BY k),
grps AS (SELECT greatest(1, (count(*) + {SHARDS * ROWS_PER_GROUP - 1}) // {SHARDS * ROWS_PER_GROUP}) AS n FROM docs)
SELECT doc_id, (n_bytes + 16)::BIGINT AS size, crc::BIGINT AS text_crc32, 'key' AS law, shard::INTEGER AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY (g + crc) % grps.n, doc_id NULLS FIRST, crc, n_bytes) - 1 AS slot, grown_shard::INTEGER AS grown_shard
FROM docs JOIN best USING (k), grps
"""
