"""Strings, numbers and encodings: Spark's own functions under the names of this library."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decimal(text: Column) -> Column:
    """A number with optional commas and a final k, M or G (thousands, millions, milliards); null if it is none."""
    bare = F.regexp_replace(F.trim(text), ",", "")
    unit = F.when(bare.rlike("[kK]$"), 1_000).when(bare.rlike("[mM]$"), 1_000_000).when(bare.rlike("[gG]$"), 1_000_000_000).otherwise(1)
    return F.when(bare.rlike(r"^[+-]?[0-9]*\.?[0-9]+(?:[eE][+-]?[0-9]+)?[kKmMgG]?$"), (F.regexp_replace(bare, "[kKmMgG]$", "").cast("double") * unit).cast("bigint"))


def percent_decoded(text: Column) -> Column:
    """Percent escapes as characters; a plus sign stays a plus sign."""
    return F.url_decode(F.regexp_replace(text, r"\+", "%2B"))


def base64_decoded(text: Column) -> Column:
    return F.unbase64(text)


def hex_decoded(text: Column) -> Column:
    return F.unhex(text)


def tokens(text: Column, delimiters: str = r"\s+") -> Column:
    """The parts between delimiters, without empty ones."""
    return F.filter(F.split(text, delimiters), lambda x: x != "")


def found_at(text: Column, part: Column) -> Column:
    """0-based place of a substring, -1 without it."""
    return F.instr(text, part) - 1


def every_place(text: Column, part: str) -> Column:
    """All 0-based places of a substring, overlapping ones included."""
    return F.filter(F.sequence(F.lit(0), F.greatest(F.length(text) - len(part), F.lit(0))), lambda i: F.substring(text, i + 1, F.lit(len(part))) == part)


def number_text(value: Column, digits: int = 6) -> Column:
    """A double with at most ``digits`` significant digits, without final zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string(f"%.{digits}f", value), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def ones(value: Column) -> Column:
    """Bits set."""
    return F.bit_count(value)


def packed(seq: Column, letters: str = "ACGT") -> Column:
    """A sequence of at most 31 bases as one number, base 4, first base highest."""
    return F.aggregate(F.filter(F.split(seq, ""), lambda c: c != ""), F.lit(0).cast("bigint"), lambda acc, c: F.shiftleft(acc, 2).bitwiseOR((F.instr(F.lit(letters), c) - 1).cast("bigint")))


def unpacked(code: Column, length: int, letters: str = "ACGT") -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(length - 1), F.lit(0), F.lit(-1)), lambda i: F.substring(F.lit(letters), (F.call_function("shiftright", code, (i * 2).cast("int")).bitwiseAND(3) + 1).cast("int"), F.lit(1))), "")
