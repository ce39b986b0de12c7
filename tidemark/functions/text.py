"""Column functions over text: spoken forms, display width, boundaries, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def spoken(text: Column) -> Column:
    """STR1: the text without white space and punctuation."""
    return F.regexp_replace(text, r"(?U)[\s\p{P}]", "")


def display_length(text: Column) -> Column:
    """STR4: ASCII counts a half, combining marks nothing, the rest one."""
    visible = F.regexp_replace(text, r"\p{M}", "")
    ascii_only = F.regexp_replace(visible, r"[^\x00-\x7F]", "")
    return F.char_length(visible) - F.char_length(ascii_only) * F.lit(0.5).cast("double")


def comparable(text: Column) -> Column:
    """STR16: letters and digits, lower case."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))


def alnum_count(text: Column) -> Column:
    """AGG5: how many letters and digits."""
    return F.char_length(F.regexp_replace(text, r"[^\p{L}\p{N}]", "")).cast("long")


def punctuation_boundary(text: Column, following: Column) -> Column:
    """STR6: 'hard', 'soft' or NULL at the end of a token."""
    bare = F.rtrim(text)
    in_number = F.rlike(bare, F.lit(r"[0-9],$")) & F.rlike(F.ltrim(F.coalesce(following, F.lit(""))), F.lit(r"^[0-9]"))
    closed = F.regexp_replace(bare, "[”’」』》〉】〕）)\\]}\"']+$", "")
    return (
        F.when(in_number, F.lit(None).cast("string"))
        .when(F.rlike(closed, F.lit("[。！？!?]$")), "hard")
        .when(F.rlike(closed, F.lit("[，,；;]$")), "soft")
        .when(closed.endswith(".") & ~F.rlike(closed, F.lit(r"[0-9]\.$")), "hard")
    )


def needs_space(left: Column, right: Column) -> Column:
    """AGG15: two ASCII letters or digits must not touch."""
    return F.rlike(left, F.lit("[A-Za-z0-9]$")) & F.rlike(right, F.lit("^[A-Za-z0-9]"))


def clip_name(text: Column, template: str) -> Column:
    """STR20: the first line and the template's name."""
    return F.concat(F.trim(F.split_part(text, F.lit("\n"), F.lit(1))), F.lit(" - " + template))


def safe_file_name(text: Column, most: int = 60) -> Column:
    """STR21: forbidden characters become '-', at most `most` characters."""
    return F.substring(F.translate(text, '/\\:*?"<>|\n\r\t', "------------"), 1, most)


def utf16_units(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16LE")) / 2).cast("long")


def valid_script(text: Column, most: int = 20000) -> Column:
    """FIL16: at most `most` UTF-16 units, no control character but line ends and tabs."""
    return (utf16_units(text) <= most) & ~F.rlike(text, F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]"))


def canonical_uuid(text: Column) -> Column:
    """FIL17"""
    return F.rlike(text, F.lit("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"))


def vocabulary(text: Column) -> Column:
    """FIL15: terms in order of first occurrence."""
    parts = F.transform(F.split(text, "[\\n\\r,，;；、]+"), lambda x: F.trim(x))
    return F.array_distinct(F.filter(parts, lambda x: F.length(x) > 0))


def valid_vocabulary(terms: Column) -> Column:
    """FIL15: at most 100 terms, 2000 characters together, 64 each, no control characters."""
    total = F.aggregate(terms, F.lit(0), lambda a, x: a + F.char_length(x))
    return (F.size(terms) <= 100) & (total <= 2000) & F.forall(terms, lambda x: (F.char_length(x) <= 64) & ~F.rlike(x, F.lit(r"[\x00-\x1F\x7F]")))


def numeral(value: Column) -> Column:
    """STR8: Chinese numeral of an integer from 0 to 9999, digit by digit in SQL."""
    digits = F.lit("零一二三四五六七八九")
    digit = lambda n: F.substr(digits, (n + 1).cast("int"), F.lit(1))
    n = value.cast("int")
    k, h, t, u = (F.floor(n / 1000) % 10).cast("int"), (F.floor(n / 100) % 10).cast("int"), (F.floor(n / 10) % 10).cast("int"), n % 10
    empty = F.lit("")
    thousands = F.when(k > 0, F.concat(digit(k), F.lit("千"))).otherwise(empty)
    hundreds = F.when(h > 0, F.concat(digit(h), F.lit("百"))).otherwise(empty)
    gap_h = F.when((k > 0) & (h == 0) & ((t > 0) | (u > 0)), "零").otherwise("")
    tens = F.when(t > 0, F.concat(digit(t), F.lit("十"))).otherwise(empty)
    gap_t = F.when((h > 0) & (t == 0) & (u > 0), "零").otherwise("")
    units = F.when(u > 0, digit(u)).otherwise(empty)
    whole = F.concat(thousands, gap_h, hundreds, gap_t, tens, units)
    return F.when((n < 0) | (n > 9999), F.lit(None).cast("string")).when(n == 0, "零").when(whole.startswith("一十"), F.substring(whole, 2, 100)).otherwise(whole)


def strip_event_tags(text: Column) -> Column:
    """STR15: recogniser tags go, white space is single, none before closing punctuation."""
    bare = F.regexp_replace(text, r"<\|[^|]*\|>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"\s+", " "), r" ([,.!?;:])", "$1"))


def repeats_itself(text: Column) -> Column:
    """STR14: some unit of 4 to 64 characters four or more times in a row, 32 characters at least and half of the text."""
    found = F.regexp_extract(text, r"(?s)((.{4,64}?)\2{3,})", 1)
    return (F.char_length(found) >= 32) & (F.char_length(found) * 2 >= F.char_length(text))
