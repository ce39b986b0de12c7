"""Exact rational time as STRUCT<num, den> of DECIMAL(38,0), and whole-number clocks.

Seconds are never doubles here. Values are reduced after every step, so that products stay in range.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDE = "decimal(38,0)"
RATE = 16000


def gcd(a: Column, b: Column) -> Column:
    """Euclid with a bounded number of steps (64-bit operands need at most 92)."""
    start = F.struct(F.abs(a).cast("long").alias("x"), F.abs(b).cast("long").alias("y"))
    step = lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), (s["x"] % s["y"]).alias("y")))
    return F.greatest(F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step)["x"], F.lit(1))


def rational(num: Column, den: Column) -> Column:
    g = gcd(num, den)
    sign = F.when(den < 0, F.lit(-1)).otherwise(F.lit(1))
    return F.struct(_div(sign * num, g).alias("num"), _div(sign * den, g).alias("den"))


def _div(a: Column, b: Column) -> Column:
    """Exact quotient of whole numbers, through 64-bit integers."""
    return _whole(a, b).cast(WIDE)


def parse(text: Column) -> Column:
    """TIM1: 'n/ds' or 'ns'; NULL for anything else."""
    num = F.regexp_extract(text, r"^(-?[0-9]+)(?:/([0-9]+))?s$", 1)
    den = F.regexp_extract(text, r"^(-?[0-9]+)(?:/([0-9]+))?s$", 2)
    n = F.when(num != "", num.cast("long"))
    d = F.when(den != "", den.cast("long")).otherwise(F.lit(1).cast("long"))
    return F.when(n.isNotNull() & (d > 0), rational(n, d))


def show(r: Column) -> Column:
    """As a fraction is written: 'n' or 'n/d'."""
    return F.when(r["den"] == 1, r["num"].cast("string")).otherwise(F.concat_ws("/", r["num"].cast("string"), r["den"].cast("string")))


def add(a: Column, b: Column) -> Column:
    return rational((a["num"] * b["den"] + b["num"] * a["den"]).cast("long"), (a["den"] * b["den"]).cast("long"))


def multiply(a: Column, b: Column) -> Column:
    return rational((a["num"] * b["num"]).cast("long"), (a["den"] * b["den"]).cast("long"))


def less(a: Column, b: Column) -> Column:
    return (a["num"] * b["den"]).cast(WIDE) < (b["num"] * a["den"]).cast(WIDE)


def _whole(a: Column, b: Column) -> Column:
    """a / b where b divides a: as decimals, so that no digit is lost."""
    return (a.cast("decimal(20,0)") / b.cast("decimal(18,0)")).cast("long")


def floor_div(a: Column, b: Column) -> Column:
    """Floor of a / b for whole numbers, b > 0."""
    return _whole(a - F.pmod(a, b), b)


def sample_index(r: Column, rate: int = RATE) -> Column:
    """TIM2: floor(t * rate + 1/2)."""
    return floor_div((2 * rate * r["num"] + r["den"]).cast("long"), (2 * r["den"]).cast("long"))


def frame_floor(ms: Column, num: int = 25, den: int = 1) -> Column:
    """TIM3: the frame that holds a time in milliseconds, at num / den frames a second."""
    return floor_div(ms.cast("long") * num, F.lit(1000 * den).cast("long"))


def frame_ceil(ms: Column, num: int = 25, den: int = 1) -> Column:
    return -floor_div(-ms.cast("long") * num, F.lit(1000 * den).cast("long"))


def half_even(num: Column, den: Column) -> Column:
    """Nearest whole number of num / den >= 0, halves to the even one."""
    q, twice = floor_div(num, den), 2 * F.pmod(num, den)
    return q + F.when((twice > den) | ((twice == den) & (q % 2 == 1)), 1).otherwise(0)


def timecode(frame: Column, num: int = 25, den: int = 1) -> Column:
    """TIM4: HH:MM:SS,mmm of a frame number."""
    ms = half_even(frame.cast("long") * 1000 * den, F.lit(num).cast("long"))
    two = lambda x, n=2: F.lpad(x.cast("string"), n, "0")
    hours = floor_div(ms, F.lit(3600000))
    shown = F.when(hours < 10, two(hours)).otherwise(hours.cast("string"))
    return F.concat(shown, F.lit(":"), two(floor_div(ms, F.lit(60000)) % 60), F.lit(":"), two(floor_div(ms, F.lit(1000)) % 60), F.lit(","), two(ms % 1000, 3))
