"""Queries over timed words: sessions, captions, text and time functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import rational as R
from tidemark.functions import text as T
from tidemark.operators import sessions as S
from tidemark.plans.derive import WORDS, table, words

QUERIES, ORACLES = {}, {}
KEY, POS = ["doc"], ["pos"]


def query(sql: str | None = None):  # noqa: ANN201
    def register(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


BLOCKS = WORDS + """,
blk AS (SELECT *, sum(CASE WHEN start_ms - pe >= 500 OR pt LIKE '%,' THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY pos) AS block
        FROM (SELECT *, lag(end_ms) OVER (PARTITION BY doc ORDER BY pos) AS pe, lag(text) OVER (PARTITION BY doc ORDER BY pos) AS pt FROM word)),
cap AS (SELECT doc, block, start_ms, CASE WHEN n - end_ms > 0 AND n - end_ms <= 200 THEN n ELSE end_ms END AS end_ms, text FROM
  (SELECT *, lead(start_ms) OVER (PARTITION BY doc ORDER BY block) AS n FROM
   (SELECT doc, block, min(start_ms) AS start_ms, max(end_ms) AS end_ms, string_agg(sep || text, '' ORDER BY pos) AS text FROM
    (SELECT *, CASE WHEN regexp_matches(lag(text) OVER (PARTITION BY doc, block ORDER BY pos), '[A-Za-z0-9]$') AND regexp_matches(text, '^[A-Za-z0-9]') THEN ' ' ELSE '' END AS sep FROM blk) GROUP BY doc, block)))
"""


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = (S.pause_before(KEY, POS) >= 500) | F.lag("text").over(S.ordered(KEY, POS)).endswith(",")
    return S.sessions(words(spark, sf_dir), KEY, POS, new)


def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.bridged(S.joined_text(blocks(spark, sf_dir), ["doc", "block"], POS), KEY, ["block"])


@query(f"WITH {BLOCKS} SELECT doc AS conv_id, block AS caption_no, start_ms * 25 // 1000 AS start_frame, (end_ms * 25 + 999) // 1000 AS end_frame, text FROM cap")
def slice_caption_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captions(spark, sf_dir).select(F.col("doc").alias("conv_id"), F.col("block").alias("caption_no"), R.frame_floor(F.col("start_ms")).alias("start_frame"), R.frame_ceil(F.col("end_ms")).alias("end_frame"), "text")


@query(f"WITH {WORDS} SELECT doc, pos, CASE WHEN n - end_ms > 0 AND n - end_ms <= 200 THEN n ELSE end_ms END AS end_ms FROM (SELECT *, lead(start_ms) OVER (PARTITION BY doc ORDER BY pos) AS n FROM word)")
def win1_gap_bridging(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.bridged(words(spark, sf_dir), KEY, POS).select("doc", "pos", "end_ms")


@query(f"WITH {WORDS} SELECT doc, pos, sum(CASE WHEN start_ms - pe >= 500 THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY pos)::BIGINT AS block FROM (SELECT *, lag(end_ms) OVER (PARTITION BY doc ORDER BY pos) AS pe FROM word)")
def win3_pause_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sessions(words(spark, sf_dir), KEY, POS, S.pause_before(KEY, POS) >= 500).select("doc", "pos", "block")


@query(f"""WITH {WORDS}, r AS (SELECT *, (start_ms * 2 + 50) // 100 * 50 AS s, (end_ms * 2 + 50) // 100 * 50 AS e FROM word),
c AS (SELECT doc, pos, greatest(s, coalesce(lag(e) OVER (PARTITION BY doc ORDER BY pos), 0))::BIGINT AS "start", e::BIGINT AS "end" FROM r) SELECT *, "end" > "start" AS ok FROM c""")
def win7_running_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.clamped(words(spark, sf_dir), KEY, POS).select("doc", "pos", "start", "end", "ok")


@query(f"WITH {WORDS} SELECT doc, (pos - 1) AS pos, k AS \"window\" FROM word, LATERAL (SELECT unnest(range(0, (SELECT max(pos) FROM word w WHERE w.doc = word.doc) // 12 + 1)) AS k) WHERE pos - 1 >= k * 12 - 3 AND pos - 1 < k * 12 + 15 AND k * 12 <= (SELECT max(pos) - 1 FROM word w WHERE w.doc = word.doc)")
def win12_context_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = words(spark, sf_dir).select("doc", (F.col("pos") - 1).alias("pos"))
    return S.context_windows(w, KEY, step=12, before=3, after=15).select("doc", "pos", "window")


@query(f"WITH {WORDS} SELECT doc, pos, e - length(text) AS char_start, e AS char_end FROM (SELECT *, sum(length(text)) OVER (PARTITION BY doc ORDER BY pos)::BIGINT AS e FROM word)")
def win14_char_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.char_offsets(words(spark, sf_dir), KEY, POS).select("doc", "pos", "char_start", "char_end")


LINES = """
ln AS (SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)
"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("p", "line"))
    return split.select("doc", "line", (F.col("p") + 1).cast("long").alias("pos"))


@query(f"""WITH {LINES}, o AS (SELECT *, length(line) BETWEEN 6 AND 8192 AS ok FROM ln),
n AS (SELECT *, CASE WHEN ok AND lag(ok) OVER w AND line = lag(line) OVER w THEN 0 ELSE 1 END AS new FROM o WINDOW w AS (PARTITION BY doc ORDER BY pos)),
r AS (SELECT *, sum(new) OVER (PARTITION BY doc ORDER BY pos) AS run FROM n)
SELECT doc, min(pos) AS first, max(pos) AS last, count(*) AS n FROM r WHERE ok GROUP BY doc, run HAVING count(*) >= 3""")
def win18_repeated_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.repeated_runs(lines(spark, sf_dir), KEY, POS, "line", F.char_length("line").between(6, 8192))


@query(f"WITH {BLOCKS} SELECT doc, block, text, start_ms, max_end AS end_ms FROM (SELECT doc, block, min(start_ms) AS start_ms, max(end_ms) AS max_end, string_agg(sep || text, '' ORDER BY pos) AS text FROM (SELECT *, CASE WHEN regexp_matches(lag(text) OVER (PARTITION BY doc, block ORDER BY pos), '[A-Za-z0-9]$') AND regexp_matches(text, '^[A-Za-z0-9]') THEN ' ' ELSE '' END AS sep FROM blk) GROUP BY doc, block)")
def agg15_join_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.joined_text(blocks(spark, sf_dir), ["doc", "block"], POS)


CUES = f"""WITH {BLOCKS}, f AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY block) AS n, start_ms * 25 // 1000 AS a, (end_ms * 25 + 999) // 1000 AS b, text FROM cap),
tc AS (SELECT *, a * 40 AS ams, b * 40 AS bms FROM f),
cue AS (SELECT doc, n, text, format('{{:02d}}:{{:02d}}:{{:02d}},{{:03d}}', ams // 3600000, ams // 60000 % 60, ams // 1000 % 60, ams % 1000) AS t0, format('{{:02d}}:{{:02d}}:{{:02d}},{{:03d}}', bms // 3600000, bms // 60000 % 60, bms // 1000 % 60, bms % 1000) AS t1 FROM tc)
"""


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = slice_caption_conversations(spark, sf_dir).withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy("caption_no")))
    return c.select(F.col("conv_id").alias("doc"), "n", "text", R.timecode(F.col("start_frame")).alias("t0"), R.timecode(F.col("end_frame")).alias("t1"))


@query(CUES + " SELECT doc, string_agg(n || chr(10) || t0 || ' --> ' || t1 || chr(10) || text || chr(10) || chr(10), '' ORDER BY n) AS srt FROM cue GROUP BY doc")
def snk1_srt(spark: SparkSession, sf_dir: str) -> DataFrame:
    cue = F.concat(F.col("n").cast("string"), F.lit("\n"), "t0", F.lit(" --> "), "t1", F.lit("\n"), "text", F.lit("\n\n"))
    return cues(spark, sf_dir).groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", cue.alias("c")))), lambda x: x["c"]), "").alias("srt"))


@query(CUES + " SELECT doc, n, t0, t1, trim(replace(text, chr(13) || chr(10), chr(10))) AS text, t1 > t0 AS ok FROM cue")
def snk2_srt_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cues(spark, sf_dir).select("doc", "n", "t0", "t1", F.trim(F.replace("text", F.lit("\r\n"), F.lit("\n"))).alias("text"), (F.col("t1") > F.col("t0")).alias("ok"))


@query(CUES + " SELECT doc, n, t0, t1 FROM cue")
def tim4_timecode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cues(spark, sf_dir).select("doc", "n", "t0", "t1")


@query(f"WITH {WORDS} SELECT doc, pos, start_ms * 30000 // 1001000 AS start_frame, (end_ms * 30000 + 1000999) // 1001000 AS end_frame FROM word")
def tim3_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = words(spark, sf_dir)
    return w.select("doc", "pos", R.frame_floor(F.col("start_ms"), 30000, 1001).alias("start_frame"), R.frame_ceil(F.col("end_ms"), 30000, 1001).alias("end_frame"))


@query(f"WITH {WORDS} SELECT doc, pos, (2 * start_ms * 16000 + 1000) // 2000 AS sample FROM word")
def tim2_sample_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(spark, sf_dir).select("doc", "pos", R.sample_index(R.rational(F.col("start_ms"), F.lit(1000))).alias("sample"))


@query(f"WITH {WORDS} SELECT doc, pos, CASE WHEN start_ms % 1000 = 0 THEN (start_ms // 1000)::VARCHAR ELSE (start_ms // gcd(start_ms, 1000)) || '/' || (1000 // gcd(start_ms, 1000)) END AS seconds FROM word")
def tim1_rational_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = words(spark, sf_dir)
    wire = F.concat(F.col("start_ms").cast("string"), F.lit("/1000s"))
    return w.select("doc", "pos", R.show(R.parse(wire)).alias("seconds"))


@query(f"WITH {WORDS}, t AS (SELECT doc, max(end_ms) AS pcm, max(end_ms) - doc % 3 AS total FROM word GROUP BY doc) SELECT doc, pos, CASE WHEN pcm - total > 0 AND pcm - total <= 1 AND end_ms > total AND end_ms <= pcm THEN total ELSE end_ms END AS end_ms, (end_ms > total AND NOT (pcm - total > 0 AND pcm - total <= 1)) AS refused FROM word JOIN t USING (doc)")
def tim6_endpoint_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = words(spark, sf_dir)
    t = w.groupBy("doc").agg(F.max("end_ms").alias("pcm")).withColumn("total", F.col("pcm") - F.pmod("doc", F.lit(3)))
    near = (F.col("pcm") - F.col("total") > 0) & (F.col("pcm") - F.col("total") <= 1)
    return w.join(t, "doc").select("doc", "pos", F.when(near & (F.col("end_ms") > F.col("total")) & (F.col("end_ms") <= F.col("pcm")), F.col("total")).otherwise(F.col("end_ms")).alias("end_ms"), ((F.col("end_ms") > F.col("total")) & ~near).alias("refused"))


@query(f"WITH {WORDS} SELECT doc, pos, regexp_replace(text, '[\\s\\p{{P}}]', '', 'g') AS spoken, length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS alnum, lower(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS comparable FROM word")
def str1_agg5_str16_spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    return words(spark, sf_dir).select("doc", "pos", T.spoken(c).alias("spoken"), T.alnum_count(c).alias("alnum"), T.comparable(c).alias("comparable"))


@query("WITH v AS (SELECT doc_id, regexp_replace(text, '\\p{M}', '', 'g') AS t FROM documents) SELECT doc_id, length(t) - length(regexp_replace(t, '[^\\x00-\\x7F]', '', 'g')) * 0.5::DOUBLE AS width FROM v")
def str4_display_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.display_length(F.col("text")).alias("width"))


@query(f"""WITH {WORDS}, n AS (SELECT *, coalesce(lead(text) OVER (PARTITION BY doc ORDER BY pos), '') AS nx, regexp_replace(rtrim(text), '[”’」』》〉】〕）)\\]}}"'']+$', '') AS c FROM word)
SELECT doc, pos, CASE WHEN regexp_matches(rtrim(text), '[0-9],$') AND regexp_matches(ltrim(nx), '^[0-9]') THEN NULL WHEN regexp_matches(c, '[。！？!?]$') THEN 'hard' WHEN regexp_matches(c, '[，,；;]$') THEN 'soft' WHEN c LIKE '%.' AND NOT regexp_matches(c, '[0-9]\\.$') THEN 'hard' END AS boundary FROM n""")
def str6_punctuation_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    following = F.lead("text").over(S.ordered(KEY, POS))
    return words(spark, sf_dir).select("doc", "pos", T.punctuation_boundary(F.col("text"), following).alias("boundary"))


@query("""WITH p AS (SELECT p_partkey, p_size * 199 % 10000 AS n FROM part), d AS (SELECT *, n // 1000 AS k, n // 100 % 10 AS h, n // 10 % 10 AS t, n % 10 AS u, '零一二三四五六七八九' AS z FROM p),
w AS (SELECT *, CASE WHEN k > 0 THEN substr(z, k + 1, 1) || '千' ELSE '' END || CASE WHEN h > 0 THEN substr(z, h + 1, 1) || '百' WHEN k > 0 AND (t > 0 OR u > 0) THEN '零' ELSE '' END || CASE WHEN t > 0 THEN substr(z, t + 1, 1) || '十' WHEN h > 0 AND u > 0 THEN '零' ELSE '' END || CASE WHEN u > 0 THEN substr(z, u + 1, 1) ELSE '' END AS s FROM d)
SELECT p_partkey, n, CASE WHEN n = 0 THEN '零' WHEN s LIKE '一十%' THEN substr(s, 2) ELSE s END AS numeral FROM w""")
def str8_numerals(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 199 % 10000).alias("n"))
    return p.withColumn("numeral", T.numeral(F.col("n")))


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace('<|en|>' || text, '<\\|[^|]*\\|>', ' ', 'g'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), ' ([,.!?;:])', '\\1', 'g')) AS text FROM documents")
def str15_strip_event_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.strip_event_tags(F.concat(F.lit("<|en|>"), "text")).alias("text"))


@query()
def str14_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir)
    return rows.select("doc", "pos", T.repeats_itself(F.col("line")).alias("repeats"))


@query("SELECT doc_id, trim(string_split(text, chr(10))[1]) || ' - Title' AS name, substr(translate(text, '/\\:*?\"<>|' || chr(10) || chr(13) || chr(9), '------------'), 1, 60) AS file FROM documents")
def str20_str21_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.clip_name(c, "Title").alias("name"), T.safe_file_name(c).alias("file"))


@query("SELECT doc_id, sha256(text) AS sha, octet_length(encode(text)) AS n FROM documents")
def hsh1_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.octet_length("text").cast("long").alias("n"))


@query("WITH v AS (SELECT item_id, list_filter(list_transform(string_split_regex(text, '[\\n\\r,，;；、]+'), lambda x: trim(x)), lambda x: length(x) > 0) AS t FROM benchmark), d AS (SELECT item_id, list_filter(t, lambda x, i: list_position(t, x) = i) AS t FROM v) SELECT item_id, array_to_string(t, '|') AS terms, len(t) <= 100 AND coalesce(list_sum(list_transform(t, lambda x: length(x))), 0) <= 2000 AND len(list_filter(t, lambda x: length(x) > 64)) = 0 AS ok FROM d")
def fil15_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "benchmark").select("item_id", T.vocabulary(F.col("text")).alias("t"))
    return v.select("item_id", F.array_join("t", "|").alias("terms"), T.valid_vocabulary(F.col("t")).alias("ok"))


@query("SELECT doc_id, (length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g'))) <= 3000 AND NOT regexp_matches(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{9F}]') AS ok FROM documents")
def fil16_script_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.valid_script(F.col("text"), 3000).alias("ok"))


UUID = "concat(substr(md5(event_id::VARCHAR), 1, 8), '-', substr(md5(event_id::VARCHAR), 9, 4), '-', substr(md5(event_id::VARCHAR), 13, 4), '-', substr(md5(event_id::VARCHAR), 17, 4), '-', substr(md5(event_id::VARCHAR), 21, 12 - (event_id % 5 = 0)::INT))"


@query(f"WITH u AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN upper({UUID}) ELSE {UUID} END AS id FROM events) SELECT event_id, regexp_matches(id, '^[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}$') AS ok FROM u")
def fil17_uuid(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.md5(F.col("event_id").cast("string"))
    cut = F.when(F.col("event_id") % 5 == 0, 11).otherwise(12)
    raw = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substr(h, F.lit(21), cut))
    return table(spark, sf_dir, "events").select("event_id", T.canonical_uuid(F.when(F.col("event_id") % 7 == 0, F.upper(raw)).otherwise(raw)).alias("ok"))


@query(f"WITH {BLOCKS} SELECT doc, block, (length(trim(text)) BETWEEN 1 AND 2000) AND end_ms > start_ms AND start_ms >= coalesce(lag(end_ms) OVER (PARTITION BY doc ORDER BY block), 0) AND NOT regexp_matches(text, '[\\x00-\\x09\\x0B-\\x1F]') AS ok FROM cap")
def fil13_win2_validate_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.coalesce(F.lag("end_ms").over(S.ordered(KEY, ["block"])), F.lit(0))
    ok = F.char_length(F.trim("text")).between(1, 2000) & (F.col("end_ms") > F.col("start_ms")) & (F.col("start_ms") >= before) & ~F.rlike("text", F.lit(r"[\x00-\x09\x0B-\x1F]"))
    return captions(spark, sf_dir).select("doc", "block", ok.alias("ok"))


@query(f"WITH {BLOCKS} SELECT doc, block, text FROM (SELECT doc, block, trim(regexp_replace(text, '\\p{{P}}', '', 'g')) AS text FROM cap) WHERE text <> ''")
def fil9_drop_empty_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captions(spark, sf_dir).select("doc", "block", F.trim(F.regexp_replace("text", r"\p{P}", "")).alias("text")).where("text <> ''")


@query(f"""WITH {BLOCKS}, f AS (SELECT doc, block, start_ms * 25 // 1000 AS a, (end_ms * 25 + 999) // 1000 AS b, text FROM cap),
g AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc ORDER BY block), 0) AS p FROM f)
SELECT doc, p AS start_frame, a AS end_frame, 'gap' AS kind FROM g WHERE a > p UNION ALL SELECT doc, a, b, 'title' FROM g
UNION ALL SELECT doc, max(b), max(b) + 25, 'gap' FROM f GROUP BY doc""")
def win16_snk3_gap_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = slice_caption_conversations(spark, sf_dir).select(F.col("conv_id").alias("doc"), "caption_no", F.col("start_frame").alias("a"), F.col("end_frame").alias("b"))
    total = f.groupBy("doc").agg((F.max("b") + 25).alias("total"))
    from tidemark.operators.intervals import tiled

    return tiled(f, total).select("doc", F.col("a").alias("start_frame"), F.col("b").alias("end_frame"), "kind")
