"""Streams over folders that grow: lines cut in the middle, restarts, state carried, timers, two claimers, retention, heartbeats."""

import json
import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import jobs as J
from tidemark.streaming import live as L


def tail(spark, folder, where, **options):
    spark.dataSource.register(L.LogTail)
    stream = spark.readStream.format("tidemark_log_tail").options(path=str(folder), **options).load()
    return sorted((r.file, r["at"], r.line) for r in J.run_to_files(stream, str(where)).collect())


def test_a_log_that_grows_in_the_middle_of_a_line(spark, tmp_path):
    logs, where = tmp_path / "logs", tmp_path / "where"
    logs.mkdir()
    (logs / "a.ndjson").write_bytes(b'{"n":1}\n{"n":2}\n{"n":')
    assert [x[2] for x in tail(spark, logs, where)] == ['{"n":1}', '{"n":2}']
    with (logs / "a.ndjson").open("ab") as f:
        f.write(b'3}\r\n\n{"n":4')
    (logs / "b.ndjson").write_bytes("é zürich\nlast".encode())
    (logs / "other.txt").write_bytes(b"no\n")
    got = tail(spark, logs, where)  # a new query, from the log of the first
    assert got == [("a.ndjson", 0, '{"n":1}'), ("a.ndjson", 8, '{"n":2}'), ("a.ndjson", 16, '{"n":3}'), ("a.ndjson", 25, ""), ("b.ndjson", 0, "é zürich")]
    with (logs / "a.ndjson").open("ab") as f:
        f.write(b"}\n")
    assert [x[2] for x in tail(spark, logs, where)].count('{"n":4}') == 1
    assert len(tail(spark, logs, where)) == 6


@pytest.mark.parametrize("block", [1, 7, 64, 10_000])
def test_ranges_of_any_size_give_each_line_once(tmp_path, block):
    lines = ["", "x" * 50, "é" * 9, "a", ""] * 7
    (tmp_path / "a.ndjson").write_text("\n".join(lines) + "\nrest")
    reader = L._TailReader({"path": str(tmp_path), "block": str(block)})
    end = reader.latestOffset()
    got = sorted((r for p in reader.partitions({}, end) for r in reader.read(p)), key=lambda r: r[1])
    assert [r[2] for r in got] == lines


def test_no_whole_line_is_no_progress(tmp_path):
    (tmp_path / "a.ndjson").write_bytes(b"x" * 200_000)
    assert L._TailReader({"path": str(tmp_path)}).latestOffset() == {}


def chunks(spark, rows):
    return spark.createDataFrame(rows, "u long, id long, b long, e long, text string")


def plain(rows, least=3, most=(4096, 512)):
    out, state = [], {}
    for u, i, b, e, text in sorted(rows, key=lambda r: (r[2], r[1])):
        s = state.setdefault(u, {"end": None, "chunks": 0, "warnings": 0, "text": None, "n": 0})
        if s["end"] is not None and b != s["end"]:
            out.append((u, "error", i, b, e, 0, 0))
            continue
        s["end"], s["chunks"] = e, s["chunks"] + 1
        if s["chunks"] <= most[0]:
            out.append((u, "record", i, b, e, s["chunks"], 0))
        if s["text"] is not None and s["text"] == text:
            s["n"] += 1
        else:
            s |= {"text": text, "first": i, "begin": b, "n": 1, "version": 0, "told": False}
        if s["n"] == least:
            s["warnings"] += 1
            s["told"] = s["warnings"] <= most[1]
        if s["n"] >= least and s["told"]:
            s["version"] += 1
            out.append((u, "warning", s["first"], s["begin"], e, s["n"], s["version"]))
    return sorted(out)


def test_state_is_the_same_over_one_file_many_files_and_stops(spark, tmp_path):
    rows = [(u, i, 10 * i + (5 if (u, i) == (1, 7) else 0), 10 * i + 10, "aabbbbccccccab"[(i // (u + 1)) % 14]) for u in range(3) for i in range(24)]
    want = plain(rows, 3, (20, 2))
    made = lambda s: L.diagnosed(s, "u", most_chunks=20, most_warnings=2)
    assert {k for _, k, *_ in want} == {"record", "warning", "error"}
    for name, size in (("one", 24), ("many", 5)):
        parts = [chunks(spark, [r for r in rows if i <= r[1] < i + size]) for i in range(0, 24, size)]
        assert sorted(tuple(r) for r in L.grown(parts, str(tmp_path / name), made).collect()) == want


def test_silent_work_is_ended_by_the_clock(spark, tmp_path):
    start = spark.createDataFrame([(i, "decode" if i < 4 else "job", "start") for i in range(6)], "job long, kind string, action string")
    more = spark.createDataFrame([(0, "decode", "done"), (4, "job", "cancel"), (9, "job", "done")], start.schema)
    start.write.parquet(str(tmp_path / "in"))
    with L.typed_state(spark):
        made = L.watched(spark.readStream.schema(start.schema).parquet(str(tmp_path / "in")), "job", {"decode": 12, "job": 3600})
        q = made.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "log")).outputMode("append").trigger(processingTime="500 milliseconds").start(str(tmp_path / "rows"))
        try:
            until = time.time() + 60
            while not any(p["numInputRows"] for p in q.recentProgress) and time.time() < until:
                time.sleep(0.5)
            more.write.mode("append").parquet(str(tmp_path / "in"))
            until, got = time.time() + 90, {}
            while len(got) < 5 and time.time() < until:
                time.sleep(1)
                if os.path.isdir(tmp_path / "rows/_spark_metadata"):
                    got = {r.job: r.status for r in spark.read.schema(made.schema).parquet(str(tmp_path / "rows")).collect()}
        finally:
            q.stop()
    assert got == {0: "done", 1: "timed out", 2: "timed out", 3: "timed out", 4: "cancelled"}


def queue(folder, names, cancelled=(), answered=()):
    for n in names:
        (folder / n).mkdir(parents=True)
        (folder / n / "request.json").write_text(json.dumps({"n": n}))
        (folder / n / "audio.wav").write_bytes(b"x")
        if n in cancelled:
            (folder / n / "cancel.json").write_text("{}")
        if n in answered:
            (folder / n / "response.json").write_text('{"status": "before"}')


def answers(folder):
    return {n: json.loads((folder / n / "response.json").read_text())["status"] for n in sorted(os.listdir(folder)) if (folder / n / "response.json").exists()}


def test_a_queue_is_served_by_name_one_at_a_time(spark, tmp_path):
    box = tmp_path / "box"
    queue(box, ["c", "a", "d", "b", "e"], cancelled=["b"], answered=["d"])
    (box / "f").mkdir()  # no request yet
    seen = []

    def work(df):
        seen.append([r.name for r in df.collect()])
        assert all((box / n / "audio.wav").exists() for n in seen[-1])
        return df.withColumn("result", F.get_json_object("request", "$.n"))

    L.serve(spark, str(box), str(tmp_path / "where"), work)
    assert seen == [["a"], ["c"], ["e"]]
    assert answers(box) == {"a": "done", "b": "cancelled", "c": "done", "d": "before", "e": "done"}
    assert sorted(n for n in "abcde" if (box / n / "audio.wav").exists()) == ["d"]
    beats = [json.loads(x) for x in (tmp_path / "where/service.ndjson").read_text().splitlines()]
    assert beats[0]["status"] == "started" and beats[-1]["status"] == "stopped"
    assert sum(b.get("rows", 0) for b in beats) == 4
    assert json.loads((tmp_path / "where/service.json").read_text())["status"] == "stopped"


def test_work_that_was_stopped_is_failed_and_not_done_again(spark, tmp_path):
    box, seen = tmp_path / "box", []
    queue(box, ["a", "b"])

    def work(df):
        seen.extend(r.name for r in df.collect())
        if seen == ["a"]:
            raise RuntimeError("stopped")
        return df.withColumn("result", F.lit("x"))

    with pytest.raises(Exception, match="stopped"):
        L.serve(spark, str(box), str(tmp_path / "where"), work, listener=False)
    assert answers(box) == {}
    L.serve(spark, str(box), str(tmp_path / "where"), work, listener=False)
    assert seen == ["a", "b"] and answers(box) == {"a": "failed", "b": "done"}


def test_two_claimers_share_the_keys(spark, tmp_path):
    keys, won = spark.range(200).withColumnRenamed("id", "k").repartition(4), {}

    def claim(me):
        won[me] = {r.k for r in L.claims(keys, str(tmp_path / "claims"), "k", me).where("won").collect()}

    threads = [threading.Thread(target=claim, args=(me,)) for me in ("x", "y")]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert won["x"] | won["y"] == set(range(200)) and not won["x"] & won["y"]
    again = {r.k for r in L.claims(keys, str(tmp_path / "claims"), "k", "x").where("won").collect()}
    assert again == won["x"]


def test_files_are_created_all_or_none_and_replaced_in_one_step(spark, tmp_path):
    spark.dataSource.register(L.OneStepFiles)
    rows = lambda names, text: spark.createDataFrame([(n, text) for n in names], "name string, content string").repartition(2)
    out = tmp_path / "out"
    write = lambda df, how: df.write.format("tidemark_one_step_files").option("path", str(out)).option("how", how).mode("append").save()
    write(rows("abc", "1"), "create")
    with pytest.raises(Exception, match="exists|EXISTS"):
        write(rows("dca", "2"), "create")
    assert {p.name: p.read_text() for p in out.iterdir()} == dict.fromkeys("abc", "1")
    write(rows("ad", "3"), "replace")
    assert {p.name: p.read_text() for p in out.iterdir()} == {"a": "3", "b": "1", "c": "1", "d": "3"}
