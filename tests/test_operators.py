"""Literal results of interval, signal, rational, timeline and job operators."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import gains
from tidemark.functions import rational as R
from tidemark.functions import text as T
from tidemark.operators import folds, lookups, sessions, signals
from tidemark.operators import intervals as I  # noqa: E741
from tidemark.sources import timeline
from tidemark.streaming import jobs


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "value"), [("2719951/20000s", Fraction(2719951, 20000)), ("6/4s", Fraction(3, 2)), ("5s", Fraction(5)), ("-3/9s", Fraction(-1, 3)), ("0/7s", Fraction(0)), ("x", None), ("1/0s", None)])
def test_rational(spark, text, value):
    got = one(spark, R.parse(F.lit(text)))
    assert (got and Fraction(int(got["num"]), int(got["den"]))) == (value if value is not None else got)
    if value is not None:
        assert one(spark, R.sample_index(R.parse(F.lit(text)))) == (value * 16000 + Fraction(1, 2)).__floor__()


def test_rational_algebra(spark):
    a, b = R.parse(F.lit("1001/30000s")), R.parse(F.lit("7/30s"))
    assert one(spark, R.show(R.add(a, b))) == str(Fraction(1001, 30000) + Fraction(7, 30))
    assert one(spark, R.show(R.multiply(a, b))) == str(Fraction(1001, 30000) * Fraction(7, 30))
    assert one(spark, R.less(a, b)) is True


@pytest.mark.parametrize(("frame", "text"), [(146, "00:00:05,840"), (214, "00:00:08,560"), (0, "00:00:00,000"), (9_000_000, "100:00:00,000")])
def test_timecode(spark, frame, text):
    assert one(spark, R.timecode(F.lit(frame))) == text


def test_bridging(spark):
    rows = spark.createDataFrame([(1, 0, 1000), (2, 1150, 2000), (3, 3000, 4000)], "n int, start_ms int, end_ms int").withColumn("d", F.lit(1))
    assert [r.end_ms for r in sessions.bridged(rows, ["d"], ["n"]).orderBy("n").collect()] == [1150, 2000, 4000]


def test_union_length(spark):
    rows = spark.createDataFrame([(1, 0, 5), (1, 3, 6), (1, 8, 9), (2, 4, 3)], "k int, b int, e int")
    assert {r.k: (r.covered, r.invalid) for r in I.union_length(rows, ["k"]).collect()} == {1: (7, 0), 2: (0, 1)}


def test_collision(spark):
    rows = spark.createDataFrame([(k, i, 10 * i, 10 * i + 5, f"t{i}") for k in (1, 2, 3) for i in range(3)], "k int, id int, b long, e long, text string")
    old = rows.where("k = 1").select("k", "b", "e", "text").unionByName(rows.where("k = 2").select("k", "b", "e", F.lit("other").alias("text"))).withColumn("enabled", F.lit(True)).withColumn("exact", F.lit(True))
    assert {r.k: (r.status, r.exact_matches, r.overlapping) for r in I.collision(rows, old, ["k"]).collect()} == {1: ("duplicate", 3, 3), 2: ("conflict", 0, 3), 3: ("clear", 0, 0)}


def test_overlap_buckets_lose_nothing(spark):
    rng = np.random.default_rng(1)
    raw = [(1, i, int(b), int(b + n)) for i, (b, n) in enumerate(zip(rng.integers(0, 1000, 80), rng.integers(1, 300, 80), strict=True))]
    a = spark.createDataFrame(raw, "k int, id int, b long, e long")
    c = a.select("k", F.col("id").alias("id2"), F.col("b").alias("b2"), F.col("e").alias("e2"))
    pairs = lambda d: sorted((r.id, r.id2) for r in d.select("id", "id2").collect())
    assert pairs(I.overlaps(a, c, ["k"])) == pairs(I.overlaps(a, c, ["k"], 50))


def test_greedy(spark):
    rows = spark.createDataFrame([(1, 1, 0, 4), (1, 2, 0, 6), (1, 3, 5, 7), (1, 4, 6, 8)], "k int, id int, b int, e int")
    assert sorted(r.id for r in folds.greedy(rows, ["k"]).collect()) == [2, 4]


def test_quiet_cuts():
    x = np.ones(5200)
    x[2150:2250] = 0
    cuts = signals.quiet_cuts(x, 2500, 2000, 100, 100)
    assert cuts[0][1] in range(2100, 2300) and cuts[-1][1] == 5200 and all(a[1] == b[0] for a, b in zip(cuts, cuts[1:], strict=False))


@pytest.mark.parametrize("kind", ["linear", "easeOut", "easeIn", "other"])
def test_easing_ends(spark, kind):
    assert [round(one(spark, gains.easing(F.lit(kind), F.lit(p))), 12) for p in (-1.0, 0.0, 1.0, 2.0)] == [0, 0, 1, 1]


def test_longest_prefix(spark):
    rows = spark.createDataFrame([("dialogue.a.b",), ("dialoguex",), ("music",)], "name string")
    settings = spark.createDataFrame([("dialogue", 1), ("dialogue.a", 2), ("music", 3)], "role string, gain int")
    assert {r["name"]: r.gain for r in lookups.longest_prefix(rows, settings).collect()} == {"dialogue.a.b": 2, "dialoguex": None, "music": 3}


@pytest.mark.parametrize(("text", "yes"), [("abcd" * 10, True), ("abcd" * 3, False), ("abcd" * 8 + "x" * 60 + "yz1" * 9, False), ("a b c d e f g h", False)])
def test_repetition(spark, text, yes):
    assert one(spark, T.repeats_itself(F.lit(text))) is yes


def test_nodes_keep_sibling_order():
    rows = list(timeline.nodes_of("d", b"<f><project><a/><b/><a n='1'/>t</project></f>"))
    assert [r[4] for r in rows] == ["f", "project", "a", "b", "a"] and [r[3] for r in rows][2:] == [0, 1, 2]
    assert next(timeline.nodes_of("d", b"<!DOCTYPE x [<!ENTITY a 'b'>]><x/>"))[8] == "entities"
    assert next(timeline.nodes_of("d", b"<x/>"))[8] == "not one project"


def test_expansion_clips_and_finds_cycles(spark):
    uses = spark.createDataFrame([("d", None, 1, 100, 5, 10, False), ("d", 1, 2, 0, 0, 20, True), ("d", None, 3, 0, 0, 9, False), ("d", 3, 3, 0, 0, 9, False)], "doc string, media long, ref long, off long, start long, len long, leaf boolean")
    got = {(r.ref, r.b, r.e, r.source, r.reason) for r in timeline.expanded(uses).collect()}
    assert got == {(2, 100, 110, 5, None), (3, 0, 9, 0, "cycle")}


def test_claimed_batches_are_not_worked_on_again(spark, tmp_path):
    source, where = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(5).withColumnRenamed("id", "k").write.parquet(source)
    stream = spark.readStream.schema("k long").parquet(source)

    def broken(df):
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        jobs.once(stream, where, "k", broken)
    calls = []
    jobs.once(spark.readStream.schema("k long").parquet(source), where, "k", lambda df: calls.append(1) or df)
    assert not calls
    assert {(r.k, r.status) for r in spark.read.parquet(f"{where}/answers").collect()} == {(i, "failed") for i in range(5)}


def test_interpolation_holds_the_ends(spark):
    frames = spark.createDataFrame([(1, 0, 10), (1, 4, 30)], "k int, at int, value int")
    points = spark.createDataFrame([(1, -2.0), (1, 0.0), (1, 1.0), (1, 4.0), (1, 9.0)], "k int, t double")
    assert {r.t: r.value for r in lookups.interpolated(points, frames, ["k"]).collect()} == {-2.0: 10.0, 0.0: 10.0, 1.0: 15.0, 4.0: 30.0, 9.0: 30.0}


def test_repetition_against_all_units(spark):
    import random

    rng = random.Random(2)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(10))) * rng.randrange(1, 12) + "x" * rng.randrange(60) for _ in range(120)] + ["abcd" * 20, "", "z" * 40]

    def plain(t):
        # The first place where some unit stands four times in a row; the shortest unit there, as often as it goes on.
        for i in range(len(t)):
            for n in range(4, 65):
                k = 1
                while t[i + k * n : i + (k + 1) * n] == t[i : i + n] and len(t) >= i + (k + 1) * n:
                    k += 1
                if k >= 4:
                    return k * n >= 32 and 2 * k * n >= len(t)
        return False

    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.repeats_itself(F.col("t")).alias("y")).collect()
    assert {r.i: r.y for r in got} == {i: plain(t) for i, t in enumerate(texts)}


def test_quiet_cuts_against_a_plain_search():
    rng = np.random.default_rng(4)
    x = rng.normal(size=3000) * np.repeat(rng.uniform(0, 2, 300), 10)
    cuts, at = [], 0
    while len(x) - at > 700:
        starts = range(at + 500, at + 700 - 50 + 1, 25)
        energy = [float(np.square(x[i : i + 50]).sum()) for i in starts]
        end = starts[int(np.argmin(energy))] + 25
        cuts.append((at, end))
        at = end
    cuts.append((at, len(x)))
    assert signals.quiet_cuts(x, 700, 500, 50, 25) == cuts
