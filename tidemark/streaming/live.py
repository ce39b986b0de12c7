"""Streams that live: byte-offset log tails, request queues in folders, state and timers over restarts, exclusive claims, heartbeats.

Files are reached by paths that driver and executors share (a POSIX mount; a file: URI is one too), because a claim needs a file system that can create
a file only if it is not there.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.streaming import StatefulProcessor, StreamingQueryListener
from pyspark.sql.types import StructType

from tidemark.shared import stored

#: Bytes that one task of a tail reads, about; requests that wait in a queue and are looked at.
BLOCK, MOST_PENDING = 8 * 1024 * 1024, 64
#: Records and warnings that are kept of a key (fixed values); more are counted.
MOST_CHUNKS, MOST_WARNINGS = 4096, 512
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def local(path: str) -> str:
    return path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")


def replaced(path: str, data: bytes) -> None:
    """SNK5: a file has its old content or all of the new one."""
    part = f"{path}.{uuid.uuid4().hex}.part"
    with open(part, "wb") as f:
        f.write(data)
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, path)


def created(path: str, data: bytes) -> bool:
    """Writes a file if there is none, in one step; whether it did. A reader never sees a part of it."""
    part = f"{path}.{uuid.uuid4().hex}.part"
    with open(part, "wb") as f:
        f.write(data)
    try:
        os.link(part, path)
    except FileExistsError:
        return False
    finally:
        os.unlink(part)
    return True


# Logs.


class _Range(InputPartition):
    def __init__(self, path: str, begin: int, end: int, first: bool) -> None:
        self.path, self.begin, self.end, self.first = path, begin, end, first


class _TailReader(DataSourceStreamReader):
    """Progress is a byte offset for each file, behind its last whole line. What comes after stays for a later batch, also over a restart."""

    def __init__(self, options: dict) -> None:
        self.folder, self.suffix = local(options["path"]), options.get("suffix", ".ndjson")
        self.block = int(options.get("block", BLOCK))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        out = {}
        for name in sorted(os.listdir(self.folder)):
            if name.endswith(self.suffix):
                end = self.whole(os.path.join(self.folder, name))
                if end:
                    out[name] = end
        return out

    def whole(self, path: str) -> int:
        """The offset behind the last line end, looked for from the file's end."""
        end = os.path.getsize(path)
        with open(path, "rb") as f:
            while end:
                begin = max(0, end - 65_536)
                f.seek(begin)
                at = f.read(end - begin).rfind(b"\n")
                if at >= 0:
                    return begin + at + 1
                end = begin
        return 0

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Range(os.path.join(self.folder, n), b, min(b + self.block, to), b == start.get(n, 0)) for n, to in end.items() for b in range(start.get(n, 0), to, self.block)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        """The lines that begin inside the range."""
        name = os.path.basename(partition.path)
        with open(partition.path, "rb") as f:
            at = partition.begin
            if not partition.first:
                f.seek(at - 1)
                at += len(f.readline()) - 1
            f.seek(at)
            while at < partition.end:
                line = f.readline()
                yield name, at, line.rstrip(b"\r\n").decode("utf-8", "replace")
                at += len(line)

    def commit(self, end: dict) -> None:
        pass


class LogTail(DataSource):
    """SRC12: lines of growing files in a folder (option path; suffix), each once and only when it is whole: file, at (its byte offset), line."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_log_tail"

    def schema(self) -> str:
        return "file string, at long, line string"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _TailReader(self.options)


def append_lines(lines: DataFrame, where: str, half: int) -> None:
    """Appends to a log for each value of `log`: first what comes before the middle of the middle line, then the rest. One task writes a log."""
    folder = local(where)

    def put(table: pa.Table) -> pa.Table:
        os.makedirs(folder, exist_ok=True)
        rows = table.sort_by("event_id").column("line").to_pylist()
        text = "".join(x + "\n" for x in rows).encode()
        middle = sum(len(x.encode()) + 1 for x in rows[: len(rows) // 2]) + 3
        path = f"{folder}/{table.column('log')[0].as_py()}.ndjson"
        with open(path, "r+b" if os.path.exists(path) else "wb") as f:  # at its place, so a task that runs again writes the same
            f.seek(middle if half else 0)
            f.write(text[middle:] if half else text[:middle])
        return pa.table({"log": table.column("log").slice(0, 1)})

    lines.groupBy("log").applyInArrow(put, f"log {dict(lines.dtypes)['log']}").collect()


def put_requests(rows: DataFrame, where: str) -> None:
    """Folders of a queue from rows (name, request, cancelled)."""
    folder = local(where)

    def put(part: Iterator[Row]) -> None:
        for r in part:
            os.makedirs(f"{folder}/{r['name']}", exist_ok=True)
            if r["cancelled"]:
                replaced(f"{folder}/{r['name']}/cancel.json", b"{}")
            replaced(f"{folder}/{r['name']}/request.json", r["request"].encode())

    rows.foreachPartition(put)


# Request queues.


class _QueueReader(DataSourceStreamReader):
    """Progress is a counter and the names that were taken last; a folder is taken when its request is there and no response is."""

    def __init__(self, options: dict) -> None:
        self.folder, self.most = local(options["path"]), int(options.get("most", 1))

    def initialOffset(self) -> dict:
        return {"n": 0, "names": []}

    def latestOffset(self) -> dict:
        ready = [n for n in sorted(os.listdir(self.folder)) if self.waits(n)][:MOST_PENDING][: self.most]
        last = getattr(self, "last", None) or self.initialOffset()
        if ready and ready != last["names"]:
            last = {"n": time.time_ns(), "names": ready}
        self.last = last
        return last

    def waits(self, name: str) -> bool:
        at = os.path.join(self.folder, name)
        return os.path.isfile(f"{at}/request.json") and not os.path.exists(f"{at}/response.json") and not os.path.islink(at)

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [InputPartition(n) for n in end["names"]]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        at = os.path.join(self.folder, partition.value)
        with open(f"{at}/request.json", "rb") as f:
            body = f.read()
        yield partition.value, body.decode("utf-8", "replace"), os.path.exists(f"{at}/cancel.json")

    def commit(self, end: dict) -> None:
        pass


class RequestQueue(DataSource):
    """SRC11, SRC13, STM1: folders of a queue (option path) by name, `most` at a time (1: one active job), at most MOST_PENDING of those that wait:
    name, request, cancelled. A folder is offered until it has a response, which the work on it writes."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_request_queue"

    def schema(self) -> str:
        return "name string, request string, cancelled boolean"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _QueueReader(self.options)


def claims(rows: DataFrame, where: str, key: str, claimant: str) -> DataFrame:
    """STM6: rows with `won`: whether this claimant holds the key's marker, a file that is created only if there is none. Written at once.

    A task that runs again finds its claimant's own marker, and has won; another claimant, also of another run of the same query, has not.
    Markers are dealt into 256 folders."""
    names = [*rows.columns, "won"]
    schema = ", ".join(f"`{c}` {k}" for c, k in [*rows.dtypes, ("won", "boolean")])
    folder = local(where)
    os.makedirs(folder, exist_ok=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            won = []
            for k in b.column(key).to_pylist():
                mark = hashlib.sha256(repr(k).encode()).hexdigest()
                os.makedirs(f"{folder}/{mark[:2]}", exist_ok=True)
                path = f"{folder}/{mark[:2]}/{mark}"
                if created(path, claimant.encode()):
                    won.append(True)
                else:
                    with open(path, "rb") as f:
                        won.append(f.read() == claimant.encode())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(won, pa.bool_())], names)

    return stored(rows.mapInArrow(run, schema), "claims")


def serve(spark: SparkSession, queue: str, where: str, work: Callable[[DataFrame], DataFrame], listener: bool = True) -> None:
    """STM1, STM5, STM6, SNK5, SNK13, SNK16: takes every request of a queue folder, by name, one at a time, until none waits.

    Each request is claimed first. `work` gets (name, request) of the claimed one and gives (name, result). Its response is replaced in one step: done with the
    result, cancelled if it was cancelled before, failed if another run had claimed it. Imported sound (a file audio.*) goes after the response is there."""
    spark.dataSource.register(RequestQueue)
    me, folder = uuid.uuid4().hex, local(queue)

    def batch(df: DataFrame, n: int) -> None:
        taken = claims(df, f"{where}/claims", "name", me)
        stopped = taken.where("NOT won OR cancelled").select("name", F.when(~F.col("won"), "failed").otherwise("cancelled").alias("status"), F.lit(None).cast("string").alias("result"))
        mine = taken.where("won AND NOT cancelled")
        if mine.take(1):
            stopped = stopped.unionByName(work(mine.select("name", "request")).select("name", F.lit("done").alias("status"), F.col("result").cast("string").alias("result")))

        def answer(rows: Iterator[Row]) -> None:
            for r in rows:
                at = f"{folder}/{r['name']}"
                replaced(f"{at}/response.json", json.dumps({"status": r["status"], "result": r["result"]}).encode())
                for f in os.listdir(at):
                    if f.startswith("audio."):
                        os.unlink(f"{at}/{f}")

        stopped.foreachPartition(answer)

    pulse = Heartbeat(f"{local(where)}/service") if listener else None
    if pulse:
        spark.streams.addListener(pulse)
    try:
        q = spark.readStream.format("tidemark_request_queue").option("path", queue).load().writeStream.foreachBatch(batch).option("checkpointLocation", f"{where}/log").trigger(processingTime="0 seconds").start()
        try:
            while q.isActive and any(_QueueReader({"path": queue}).waits(n) for n in os.listdir(folder)):
                q.processAllAvailable()
        finally:
            q.stop()
        if q.exception():
            raise q.exception()
    finally:
        if pulse:
            pulse.settled(spark)
            spark.streams.removeListener(pulse)


class Heartbeat(StreamingQueryListener):
    """SNK13, STM9: a line for each event of a query in <where>.ndjson, and the last state, replaced, in <where>.json."""

    def __init__(self, where: str) -> None:
        os.makedirs(os.path.dirname(where), exist_ok=True)
        self.where, self.ended = where, 0

    def tell(self, status: str, **more: object) -> None:
        line = {"status": status, "heartbeat": time.time(), **more}
        with open(f"{self.where}.ndjson", "ab") as f:
            f.write(json.dumps(line).encode() + b"\n")
        replaced(f"{self.where}.json", json.dumps(line).encode())

    def onQueryStarted(self, event) -> None:  # noqa: ANN001
        self.tell("started", run=str(event.runId))

    def onQueryProgress(self, event) -> None:  # noqa: ANN001
        self.tell("busy" if event.progress.numInputRows else "idle", run=str(event.progress.runId), batch=event.progress.batchId, rows=event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:  # noqa: ANN001
        self.tell("idle", run=str(event.runId))

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001
        self.tell("stopped", run=str(event.runId))
        self.ended += 1

    def settled(self, spark: SparkSession, queries: int = 1, most: float = 10.0) -> None:
        """Waits until the bus has told the end of so many queries."""
        until = time.time() + most
        while self.ended < queries and time.time() < until:
            time.sleep(0.05)


# Files in one step.


class _Parts(WriterCommitMessage):
    def __init__(self, moved: list[tuple[str, str]]) -> None:
        self.moved = moved


class _FileWriter(DataSourceWriter):
    """Tasks write part files; only the commit gives them their names: all or, on abort, none."""

    def __init__(self, options: dict) -> None:
        self.folder, self.how = local(options["path"]), options.get("how", "create")

    def write(self, iterator: Iterator[Row]) -> _Parts:
        os.makedirs(self.folder, exist_ok=True)
        moved = []
        for r in iterator:
            part = f"{self.folder}/.{uuid.uuid4().hex}.part"
            with open(part, "wb") as f:
                f.write(r["content"].encode())
            moved.append((part, f"{self.folder}/{r['name']}"))
        return _Parts(moved)

    def commit(self, messages: list) -> None:
        every = [x for m in messages if m for x in m.moved]
        made: list[str] = []
        try:
            for part, name in every:
                if self.how == "replace":
                    os.replace(part, name)
                else:
                    os.link(part, name)
                    made.append(name)
        except FileExistsError:
            for name in made:
                os.unlink(name)
            raise
        finally:
            self.abort(messages)

    def abort(self, messages: list) -> None:
        for m in messages:
            for part, _ in m.moved if m else ():
                if os.path.exists(part):
                    os.unlink(part)


class OneStepFiles(DataSource):
    """STM6, SNK5: rows (name, content) as files of a folder. how=create: none may be there, or nothing is written; how=replace: each in one step."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_one_step_files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _FileWriter(self.options)


# State.


@contextmanager
def typed_state(spark: SparkSession) -> Iterator[None]:
    """Stateful processors need this state store; queries that start inside have it."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class Diagnosed(StatefulProcessor):
    """STM2, STM3, STM4, WIN18: rows (id, b, e, text) of a key, in order: a chunk that does not begin where the last one ended is an error and changes nothing.

    Told: each chunk up to MOST_CHUNKS (record), an error, and a warning once `least` equal texts in a row have come, again with a later end as the
    run goes on (version). At most MOST_WARNINGS are told; what is left out is counted in n."""

    def __init__(self, key: str, least: int = 3, exact: bool = True, most_chunks: int = MOST_CHUNKS, most_warnings: int = MOST_WARNINGS) -> None:
        self.key, self.least, self.exact, self.most = key, least, exact, (most_chunks, most_warnings)

    def init(self, handle) -> None:  # noqa: ANN001
        self.place = handle.getValueState("place", "last_end long, chunks long, warnings long")
        self.run = handle.getValueState("run", "text string, first long, begin long, n int, version int, told boolean")
        self.kept = handle.getListState("warnings", "first long, version int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        end, chunks, warnings = self.place.get() if self.place.exists() else (None, 0, 0)
        text, first, begin, n, version, told = self.run.get() if self.run.exists() else (None, -1, -1, 0, 0, False)
        out, fresh = [], []
        for r in pd.concat(list(rows)).sort_values(["b", "id"]).itertuples():
            if end is not None and (r.b != end if self.exact else r.b < end):
                out.append((key[0], "error", int(r.id), int(r.b), int(r.e), 0, 0))
                continue
            end, chunks = int(r.e), chunks + 1
            if chunks <= self.most[0]:
                out.append((key[0], "record", int(r.id), int(r.b), end, int(chunks), 0))
            if text is not None and r.text == text:
                n += 1
            else:
                text, first, begin, n, version, told = r.text, int(r.id), int(r.b), 1, 0, False
            if n == self.least:
                warnings += 1
                told = warnings <= self.most[1]
                if told:
                    fresh.append((first, 1))
            if n >= self.least and told:
                version += 1
                out.append((key[0], "warning", first, begin, end, n, version))
        self.place.update((end, chunks, warnings))
        self.run.update((text, first, begin, n, version, told))
        if fresh:
            self.kept.appendList(fresh)
        yield pd.DataFrame(out, columns=[self.key, "kind", "id", "b", "e", "n", "version"])

    def close(self) -> None:
        pass


def diagnosed(stream: DataFrame, key: str, **options: object) -> DataFrame:
    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).transformWithStateInPandas(Diagnosed(key, **options), f"{key} {kind}, kind string, id long, b long, e long, n int, version int", "Append", "None")


class Watched(StatefulProcessor):
    """STM7: work (key, kind, action: start, done or cancel) ends by what is told of it, or by the clock: with no more input at all a timer ends it."""

    def __init__(self, key: str, limits: dict[str, float]) -> None:
        self.key, self.limits = key, limits

    def init(self, handle) -> None:  # noqa: ANN001
        self.handle = handle
        self.running = handle.getValueState("running", "kind string, until long")

    def row(self, key: tuple, status: str) -> pd.DataFrame:
        return pd.DataFrame([(key[0], status)], columns=[self.key, "status"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        for r in pd.concat(list(rows)).sort_values("action", key=lambda c: c != "start").itertuples():
            if r.action == "start" and not self.running.exists():
                until = int(timerValues.getCurrentProcessingTimeInMs() + 1000 * self.limits[r.kind])
                self.running.update((r.kind, until))
                self.handle.registerTimer(until)
            elif r.action != "start" and self.running.exists():
                self.handle.deleteTimer(self.running.get()[1])
                self.running.clear()
                yield self.row(key, "cancelled" if r.action == "cancel" else "done")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        if self.running.exists():
            self.running.clear()
            yield self.row(key, "timed out")

    def close(self) -> None:
        pass


def watched(stream: DataFrame, key: str, limits: dict[str, float]) -> DataFrame:
    """key, status of each piece of work that ended. limits: seconds by kind."""
    return stream.groupBy(key).transformWithStateInPandas(Watched(key, limits), f"{key} {dict(stream.dtypes)[key]}, status string", "Append", "ProcessingTime")


def grown(parts: list[DataFrame], where: str, made: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream over a folder gives that grows by one part at a time; the query stops after each part and takes up its state again."""
    from tidemark.streaming.jobs import run_to_files

    spark = parts[0].sparkSession
    with typed_state(spark):
        for part in parts:
            part.write.mode("append").parquet(f"{where}/in")
            out = run_to_files(made(spark.readStream.schema(part.schema).parquet(f"{where}/in")), where)
    return out
