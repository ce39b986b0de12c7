"""WARC archives, record-wise compressed with a Zstandard dictionary that leads each archive.

A dictionary is trained on a bounded sample of records as they are archived (SAMPLE_ROWS with the least key hashes; of a
payload of more than SAMPLE_BYTES, PIECES pieces from its begin to its end) and embedded in the leading skippable frame of every archive; each record is a
frame of its own, so a record can be read by its offset. Equal payloads are found by digest: the least
key writes the response, others write revisit records that refer to it, with the digest and the
length of the full payload. The record ID of a response that others may refer to is made from its digest; other
records are numbered within their archive. archive() writes at once: each task attempt writes an archive of its own name, and
the committed manifest names the archives that count, so neither lost executors nor repeated reads write twice.

Defined results: NULL payloads are empty ones; of rows that agree in key and payload one is the response and
the others revisit it; NULL keys sort last for the choice of a response; a very long payload is one record; payloads shorter than the least revisit length are all
responses; an empty table gives no archive. Other columns are not archived, but for a URL if there is one.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed_uniform, read, scratch, shared_dir, slices, stored

SAMPLE_ROWS, SAMPLE_BYTES, DICTIONARY_BYTES, PIECES = 600, 16_384, 64 * 1024, 4
#: Records that are read back before a batch of them goes on.
READ_RECORDS = 4_096
LEVEL = 3
LEAST_REVISIT = 0
#: The skippable frame that holds a dictionary.
MAGIC = 0x184D2A5D
SPACE = uuid.UUID("5a6bdf0e-65c4-5d2e-9a39-6f4f6f0f7d11")
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def trained(pages: DataFrame, key: str, payload: str, url: str | None, date: str) -> bytes:
    """A dictionary of the sampled records; raw content if there are too few to train on; empty without payloads."""
    import zstandard

    rows = pages.where(F.length(payload) > 0)
    n = rows.count()
    if not n:
        return b""
    u = keyed_uniform(F.col(key), F.lit("warc"))
    raw = F.encode(payload, "UTF-8")
    width = SAMPLE_BYTES // PIECES
    pieces = [F.substring(raw, (F.lit(1) + F.floor((F.octet_length(raw).cast("long") - width) * i / (PIECES - 1))).cast("int"), F.lit(width)) for i in range(PIECES)]
    some = F.when(F.octet_length(raw) <= SAMPLE_BYTES, raw).otherwise(F.concat(*pieces))
    link = F.col(url) if url else F.lit(None).cast("string")
    taken = rows.where(u < min(1.1, 2.0 * SAMPLE_ROWS / n)).select(F.col(key).alias("k"), link.alias("l"), some.alias("p"), u.alias("u")).orderBy("u", "p").limit(SAMPLE_ROWS).collect()
    sample = [record(r["k"], r["l"], bytes(r["p"]), digest_of(bytes(r["p"])), None, True, date, "0:0") for r in taken]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample).as_bytes()
    except zstandard.ZstdError:
        return b"".join(sample)[:DICTIONARY_BYTES]


def record_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, name)}>"


def record(key: object, url: str | None, payload: bytes, digest: str, first: object, is_first: bool, date: str, place: str, referred: bool = True) -> bytes:
    """The bytes of a record. The key travels in extension fields, so that a reader can return it.

    place: names the record among all others of the same writing. referred: whether others may refer to this response."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if is_first else 'revisit'}",
        f"WARC-Record-ID: {record_id('sha1:' + digest if is_first and referred else place)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        f"X-Record-Key: {json.dumps(key)}",
    ]
    if url:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    http = HTTP % len(payload)
    block = http + payload if is_first else http
    if not is_first:
        head += [f"WARC-Refers-To: {record_id('sha1:' + digest)}", f"WARC-Profile: {PROFILE}", f"X-Refers-To-Key: {json.dumps(first)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> dict:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    return {"fields": fields, "payload": payload}


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


class Archive:
    """Writes and reads one archive through any file system that its path names."""

    @staticmethod
    def at(path: str) -> tuple:
        from pyarrow import fs

        return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")

    @staticmethod
    def _uri(path: str) -> str:
        return "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path

    @classmethod
    def write(cls, path: str, dictionary: bytes, records: Iterator[bytes]) -> int:
        import zstandard

        fs, name = cls.at(cls._uri(path))
        temporary = f"{name}.{uuid.uuid4().hex}.tmp"
        fs.create_dir(name.rpartition("/")[0], recursive=True)
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdCompressor(level=LEVEL)
        n = 0
        with fs.open_output_stream(temporary, compression=None) as out:
            out.write(MAGIC.to_bytes(4, "little") + len(dictionary).to_bytes(4, "little") + dictionary)
            for raw in records:
                out.write(packer.compress(raw))
                n += 1
        fs.move(temporary, name)
        return n

    @classmethod
    def read(cls, path: str) -> Iterator[dict]:
        """Frame by frame; the dictionary comes from the archive itself."""
        import zstandard

        fs, name = cls.at(cls._uri(path))
        with fs.open_input_stream(name, compression=None) as stream:
            head = stream.read(8)
            if int.from_bytes(head[:4], "little") != MAGIC:
                raise ValueError("no dictionary frame")
            dictionary = stream.read(int.from_bytes(head[4:], "little"))
            opened = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()
            held = b""
            frame, out = opened.decompressobj(), io.BytesIO()
            while True:
                if not held:
                    held = stream.read(1 << 20)
                    if not held:
                        break
                out.write(frame.decompress(held))
                if frame.eof:
                    held = frame.unused_data
                    yield parsed(out.getvalue())
                    frame, out = opened.decompressobj(), io.BytesIO()
                else:
                    held = b""


def chosen(pages: DataFrame, key: str, payload: str, url: str | None, least: int = LEAST_REVISIT) -> DataFrame:
    """key, payload bytes, url, first key, whether the row is a response, and whether others may refer to it.

    Digests are reduced to their least key before the shuffle. The join back on the digest is a plain equi-join,
    whose large partitions adaptive execution splits; a digest that many pages share is one row on the other side.
    Only where several rows share digest and least key does their order decide: these rows are written and
    numbered as they lie there, so that a recomputation can't choose again.
    """
    body = F.coalesce(F.encode(F.col(payload), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col(key).alias("key"), body.alias("payload"), (F.col(url) if url else F.lit(None).cast("string")).alias("url")).withColumn("digest", F.sha1("payload"))
    order = F.struct(F.col("key").isNull().alias("no_key"), F.col("key"))
    each = rows.groupBy("digest", "key").agg(F.count(F.lit(1)).alias("n"))
    firsts = stored(each.groupBy("digest").agg(F.min(F.struct(order.alias("o"), "n")).alias("f")).select("digest", F.col("f.o.key").alias("first"), F.col("f.n").alias("ties")), "firsts")
    joined = rows.join(firsts, "digest")
    short = F.octet_length("payload") < least
    lead = F.col("key").eqNullSafe(F.col("first"))
    columns = ["key", "payload", "url", "first", "is_first", "referred"]
    single = joined.where((F.col("ties") == 1) | ~lead).select("*", (short | lead).alias("is_first"), (~short).alias("referred")).select(*columns)
    if not firsts.where("ties > 1").take(1):
        return single
    tied = stored(joined.where((F.col("ties") > 1) & lead).withColumn("row", F.monotonically_increasing_id()), "tied")
    leads = tied.groupBy("digest").agg(F.min("row").alias("lead"))
    return single.unionByName(tied.join(leads, "digest").select("*", (short | (F.col("row") == F.col("lead"))).alias("is_first"), (~short).alias("referred")).select(*columns))


def archive(pages: DataFrame, folder: str, key: str = "page_id", payload: str = "html", url: str | None = "url", date: str = "2026-01-01T00:00:00Z", least: int = LEAST_REVISIT) -> DataFrame:
    """Write all pages to archives under `folder`, at once; the manifest, a row for each archive: archive, records."""
    dictionary = pages.sparkSession.sparkContext.broadcast(trained(pages, key, payload, url, date))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import chain

        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}" if task else "part"

        def records() -> Iterator[bytes]:
            n = 0
            for b in slices(batches, "payload"):
                for k, p, u, first, is_first, referred in zip(*[b.column(c).to_pylist() for c in ("key", "payload", "url", "first", "is_first", "referred")], strict=True):
                    n += 1
                    yield record(k, u, p, digest_of(p), first, is_first, date, f"{folder}/{name}:{n}", referred)

        every = records()
        one = next(every, None)
        if one is None:
            return
        path = f"{folder}/{name}.warc.zst"
        n = Archive.write(path, dictionary.value, chain([one], every))
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], ["archive", "records"])

    with scratch(pages.sparkSession):
        return stored(chosen(pages, key, payload, url, least).mapInArrow(run, "archive string, records long"), "manifest", keep=True)


def records_of(archives: DataFrame, key_type: str) -> DataFrame:
    """Every record of the archives, in the order of the files: key, payload_bytes, payload_digest, record_type, refers_to.

    The payload of a response is checked against its digest and length."""
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
    if key_type not in kinds:
        raise ValueError(f"a key of type {key_type} does not travel in a record's header: make it a number or a string")
    to_arrow = kinds[key_type]

    def packed(cols: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (to_arrow, pa.int64(), pa.string(), pa.string(), to_arrow), strict=True)], ["key", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("archive").to_pylist():
                cols: list[list] = [[], [], [], [], []]
                for n, r in enumerate(Archive.read(path), 1):
                    f = r["fields"]
                    digest, size = f["WARC-Payload-Digest"].removeprefix("sha1:"), int(f["X-Payload-Length"])
                    if f["WARC-Type"] == "response" and (digest_of(r["payload"]) != digest or len(r["payload"]) != size):
                        raise ValueError(f"damaged record in {path}")
                    for col, v in zip(cols, (json.loads(f["X-Record-Key"]), size, digest, f["WARC-Type"], json.loads(f.get("X-Refers-To-Key", "null"))), strict=True):
                        col.append(v)
                    if n % READ_RECORDS == 0:
                        yield packed(cols)
                        cols = [[], [], [], [], []]
                yield packed(cols)

    return archives.mapInArrow(run, f"key {key_type}, payload_bytes long, payload_digest string, record_type string, refers_to {key_type}")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    return records_of(archive(pages, folder), pages.schema["page_id"].dataType.simpleString()).withColumnRenamed("key", "page_id")


#: Base32 of the SHA-1 in SQL: five bits at a time of the 160.
ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS h FROM p),
e AS (
    SELECT page_id, payload_bytes, h,
           array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               ((('0x' || substr(h, (i // 8) * 10 + 1, 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::INTEGER + 1, 1)), '') AS payload_digest,
           row_number() OVER (PARTITION BY h ORDER BY page_id) AS n, min(page_id) OVER (PARTITION BY h) AS first
    FROM d
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN n = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN n > 1 THEN first END AS refers_to FROM e
"""
