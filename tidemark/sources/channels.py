"""Channel layers of project documents, through nested media (REC1, MAT7): a sparse channel-by-channel weight matrix for each use of a sound.

A clip may name groups of its channels (audio-channel-source with srcCh, a volume, active, enabled). Such a layer holds for everything inside the clip: a
channel that no group of it names is not heard, a channel of a group has the group's gain, and the group's mean is taken, once: by the outermost layer
above the sound, as that is what the group's sum goes out through. A sound clip numbers the channels of its own source; all that contains it numbers
the channels of all sources in a row, so source k begins after k - 1 sources' channels.

Every use climbs from its sound to the project: from a clip to the clip that holds it, from a media to every clip that refers to it, so a shared media's sounds
come once for each way up. Each step is two joins by (document, node) and one written table; clips between which no clip lies are found beforehand by
doubling, so there are as many steps as clips above a sound.

Defined results: weight is NULL and reason is told where a layer names a channel twice or outside 1 to 64 ('channels'), where a volume cannot be read ('volume'),
where a way up comes into a media for the second time ('cycle', one row for each clip that refers to it), or
where DEEPEST clips do not lead to a project ('deep'). A layer without an active group silences
all that is in it. NULL attributes have the format's defaults: one channel, source 1, 0 dB, active, enabled. Refused documents give no rows, repeated nodes do
not occur in a document. Clips that no project shows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.shared import stored

#: Clips above a sound.
DEEPEST = 64
CHANNELS = 64
#: What holds other items, and what sounds.
HOLDERS = ("clip", "ref-clip", "sync-clip", "mc-clip", "asset-clip", "audio", "media", "project")
SOUNDS = ("asset-clip", "audio")


def attr(name: str, default: str | None = None) -> Column:
    return F.coalesce(F.try_element_at("attrs", F.lit(name)), F.lit(default))


def layers(nodes: DataFrame) -> DataFrame:
    """doc, use, channel, db, n, reason: the channels that the groups of each clip let through; a clip whose groups are all inactive has one row, of channel 0."""
    groups = nodes.where("tag = 'audio-channel-source'").select("doc", F.col("id").alias("grp"), F.col("parent").alias("use"), attr("srcCh", "1").alias("named"), (attr("active", "1") == "1") & (attr("enabled", "1") == "1"))
    groups = groups.toDF("doc", "grp", "use", "named", "heard")
    amount = attr("amount", "0dB")
    db = F.regexp_extract(amount, r"^([+-]?[0-9]+(?:\.[0-9]+)?)dB$", 1).try_cast("double")
    volumes = nodes.where("tag = 'adjust-volume'").select("doc", F.col("parent").alias("grp"), F.when(db.between(-96, 12), db).alias("db"), F.lit(True).alias("has"))
    names = F.transform(F.split("named", r"\s*,\s*"), lambda x: F.trim(x).try_cast("int"))
    told = groups.join(volumes.groupBy("doc", "grp").agg(F.min("db").alias("db"), F.count(F.lit(1)).alias("volumes"), F.count("db").alias("read")), ["doc", "grp"], "left").withColumn("names", names)
    whole = F.forall("names", lambda c: F.coalesce(c.between(1, CHANNELS), F.lit(False)))
    why = F.when(~whole, "channels").when((F.coalesce("volumes", F.lit(0)) > 1) | (F.col("volumes") > F.col("read")), "volume")
    each = told.select("doc", "use", "heard", F.coalesce("db", F.lit(0.0)).alias("db"), F.size("names").alias("n"), why.alias("reason"), F.explode("names").alias("channel"))
    merged = each.groupBy("doc", "use", "channel").agg(F.count(F.lit(1)).alias("times"), F.first("db").alias("db"), F.first("n").alias("n"), F.max("reason").alias("reason"), F.bool_or("heard").alias("heard"))
    ruled = merged.withColumn("reason", F.coalesce("reason", F.when(F.col("times") > 1, "channels")))
    # A clip is refused as a whole.
    refused = ruled.groupBy("doc", "use").agg(F.min("reason").alias("reason"))
    heard = ruled.where("heard").select("doc", "use", "channel", "db", "n")
    return refused.join(heard, ["doc", "use"], "left").select("doc", "use", F.coalesce("channel", F.lit(0)).alias("channel"), "db", "n", "reason")


def above(nodes: DataFrame) -> DataFrame:
    """doc, id, up, via: what holds each clip next, through media (via) to the clips that refer to them; up is NULL where it is the project."""
    up = stored(nodes.select("doc", "id", "tag", "parent"), "climb")
    tags = up.select("doc", F.col("id").alias("parent"), F.col("tag").alias("over"), F.col("parent").alias("further"))
    near = stored(up.join(tags, ["doc", "parent"], "left").select("doc", "id", "tag", "parent", "over", "further"), "climb")
    held = F.col("over").isNull() | F.col("over").isin(*HOLDERS)
    while near.where(~held).take(1):
        # Who is not held yet goes on from where the node above him points to.
        beyond = near.select("doc", F.col("id").alias("parent"), F.col("parent").alias("p"), F.col("over").alias("o"))
        near = stored(near.join(beyond, ["doc", "parent"], "left").select("doc", "id", "tag", F.when(held, F.col("parent")).otherwise(F.col("p")).alias("parent"), F.when(held, F.col("over")).otherwise(F.col("o")).alias("over")), "climb")
    clips = near.where(F.col("tag").isin(*HOLDERS) & ~F.col("tag").isin("media", "project") & F.col("over").isNotNull()).select("doc", "id", "parent", "over")
    media = nodes.where("tag = 'media'").select("doc", F.col("id").alias("parent"), attr("id").alias("ref"))
    users = nodes.where(F.col("tag").isin("ref-clip", "mc-clip", "sync-clip")).select("doc", F.col("id").alias("up"), attr("ref").alias("ref"))
    through = clips.where("over = 'media'").join(media, ["doc", "parent"]).join(users, ["doc", "ref"]).select("doc", "id", "up", F.col("parent").alias("via"))
    return clips.where("over <> 'media'").select("doc", "id", F.when(F.col("over") != "project", F.col("parent")).alias("up"), F.lit(None).cast("long").alias("via")).unionByName(through)


def weights(nodes: DataFrame) -> DataFrame:
    """doc, sound, path, channel, db, divisor, weight, reason: what each channel of each use of each sound clip counts for. path: the
    clips above it, nearest first; a channel that a layer shuts out has no row."""
    nodes = nodes.where("ok")
    edges, layer = stored(above(nodes), "edges"), stored(layers(nodes), "layers")
    assets = nodes.where("tag = 'asset'").select("doc", attr("id").alias("ref"), attr("audioChannels", "1").try_cast("int").alias("channels"))
    sounds = nodes.where(F.col("tag").isin(*SOUNDS)).select("doc", F.col("id").alias("sound"), attr("ref").alias("ref"), attr("srcID", "1").try_cast("int").alias("source")).join(assets, ["doc", "ref"])
    each = sounds.where(F.col("channels").between(1, CHANNELS) & (F.col("source") >= 1)).withColumn("channel", F.explode(F.sequence(F.lit(1), "channels")))
    none = lambda kind: F.lit(None).cast(kind)
    at = each.select("doc", "sound", F.col("sound").alias("at"), "channel", F.col("channel").alias("here"), ((F.col("source") - 1) * F.col("channels")).alias("shift"), F.lit(0.0).alias("db"), F.lit(1).alias("divisor"), none("string").alias("reason"), F.array().cast("array<long>").alias("path"), F.array().cast("array<long>").alias("media"))
    has = layer.groupBy("doc", F.col("use").alias("at")).agg(F.min("reason").alias("why"))
    through = layer.where("channel > 0").select("doc", F.col("use").alias("at"), F.col("channel").alias("here"), F.col("db").alias("more"), F.col("n"), F.lit(True).alias("open"))
    arrived = []
    for step in range(DEEPEST + 1):
        met = at.join(has.withColumn("layered", F.lit(True)), ["doc", "at"], "left").join(through, ["doc", "at", "here"], "left")
        heard = met.where(F.col("layered").isNull() | F.col("why").isNotNull() | F.col("open"))
        counted = heard.select("doc", "sound", "at", "channel", (F.col("here") + F.col("shift")).alias("here"), (F.col("db") + F.coalesce("more", F.lit(0.0))).alias("db"), F.coalesce("n", "divisor").alias("divisor"), F.coalesce("reason", "why").alias("reason"), "path", "media")
        climbed = counted.join(edges.withColumnRenamed("id", "at"), ["doc", "at"])
        loops = F.coalesce(F.array_contains("media", F.col("via")), F.lit(False))
        climbed = stored(climbed.withColumn("loops", loops).withColumn("reason", F.when(F.col("loops"), "cycle").otherwise(F.col("reason"))), "weights")
        arrived.append(climbed.where("up IS NULL OR loops"))
        further = climbed.where("up IS NOT NULL AND NOT loops")
        if step == DEEPEST:
            arrived.append(further.withColumn("reason", F.lit("deep")))
        at = further.select("doc", "sound", F.col("up").alias("at"), "channel", "here", F.lit(0).alias("shift"), "db", "divisor", "reason", F.array_append("path", F.col("up")).alias("path"), F.when(F.col("via").isNull(), F.col("media")).otherwise(F.array_append("media", F.col("via"))).alias("media"))
        if not further.take(1):
            break
    out = arrived[0]
    for more in arrived[1:]:
        out = out.unionByName(more)
    weight = F.when(F.col("reason").isNull(), F.pow(F.lit(10.0), F.col("db") / 20) / F.col("divisor"))
    return out.select("doc", "sound", "path", "channel", F.when(F.col("reason").isNull(), F.col("db")).alias("db"), F.when(F.col("reason").isNull(), F.col("divisor")).alias("divisor"), weight.alias("weight"), "reason")
