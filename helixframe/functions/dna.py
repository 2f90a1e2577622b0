"""Column functions over bases: complements, conversions, k-mers and template geometry.

Coordinates are 0-based and half-open throughout; sources and sinks convert at the edges.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from helixframe.functions import blocks

BASES = "ACGT"


def complement(seq: Column) -> Column:
    """Complement of A, C, G and T; any other character stays."""
    return F.translate(seq, "ACGT", "TGCA")


def reverse_complement(seq: Column) -> Column:
    """The complement read backwards; other characters stay (the rule for reads)."""
    return F.reverse(complement(seq))


def strict_reverse_complement(seq: Column) -> Column:
    """The complement read backwards with anything but A, C, G, T as N (the rule for genomes)."""
    return F.reverse(complement(F.regexp_replace(seq, "[^ACGT]", "N")))


def convert(seq: Column) -> Column:
    """Bisulfite conversion: each C reads as T."""
    return F.replace(seq, F.lit("C"), F.lit("T"))


def convert_complement(seq: Column) -> Column:
    """The complement, converted."""
    return convert(complement(seq))


def convert_reverse(seq: Column) -> Column:
    """The sequence backwards, converted."""
    return convert(F.reverse(seq))


def positions_of(seq: Column, base: str) -> Column:
    """0-based places of a base; the empty array if there is none."""
    marked = F.transform(F.split(seq, ""), lambda c, i: F.when(c == base, i))
    return F.filter(marked, lambda i: i.isNotNull())


def last_position_of(seq: Column, base: str) -> Column:
    """0-based last place of a base, -1 without one."""
    return F.when(F.instr(seq, base) > 0, F.length(seq) - F.instr(F.reverse(seq), base)).otherwise(-1)


def normalised(seq: Column) -> Column:
    """Upper case without white space."""
    return F.upper(F.regexp_replace(seq, r"\s+", ""))


def read_name(name: Column) -> Column:
    """A read's name up to the first blank or slash, without the leading sign."""
    return F.regexp_replace(F.regexp_replace(name, "^@", ""), "[ /].*$", "")


def mate_name(one: Column, two: Column) -> Column:
    """What the names of two mates share, up to the first blank or slash."""
    same = F.filter(F.sequence(F.lit(1), F.greatest(F.length(one), F.lit(1))), lambda i: F.substring(one, i, F.lit(1)) != F.substring(two, i, F.lit(1)))
    shared = F.when(F.size(same) > 0, F.substring(one, F.lit(1), F.element_at(same, 1) - 1)).otherwise(one)
    return read_name(shared)


def grams(text: Column, k: int) -> Column:
    """All overlapping substrings of ``k`` characters, by place; one pass, where single substrings would each count from the start."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1))


def kmers(seq: Column, k: int, step: int = 1) -> Column:
    """``array<struct<offset, kmer>>`` of the k-mers at every ``step``-th place that hold only A, C, G and T."""
    cut = F.transform(grams(seq, k), lambda x, i: F.struct(i.alias("offset"), x.alias("kmer")))
    return F.filter(cut, lambda x: (x["offset"] % step == 0) & (F.translate(x["kmer"], "ACGT", "") == ""))


def kmer_code(kmer: Column, letters: str = "ACGT") -> Column:
    """The k-mer as a number in base ``len(letters)``; -1 if it holds any other character."""
    digits = F.split(kmer, "")
    value = F.aggregate(digits, F.lit(0).cast("bigint"), lambda acc, c: acc * len(letters) + F.instr(F.lit(letters), c) - 1)
    return F.when(F.translate(kmer, letters, "") == "", value).otherwise(F.lit(-1).cast("bigint"))


#: Letters of the converted alphabet in their numbering.
CONVERTED = "GTA"


def bisulfite_match(read: Column, ref: Column) -> Column:
    """Asymmetric equality of two bases: a T of the read may stand on a C."""
    return (read == ref) | ((read == "T") & (ref == "C"))


def _of_both(measure) -> Callable[[Column, Column], Column]:
    """A measure of two texts, made in Arrow batches; null if either is."""

    def made(a: pa.Array, b: pa.Array) -> pa.Array:
        return pc.if_else(pc.and_(a.is_valid(), b.is_valid()), pa.array(measure(a, b).astype(np.int32)), None)

    made.__annotations__ = {"a": pa.Array, "b": pa.Array, "return": pa.Array}
    return F.arrow_udf(made, IntegerType())


def bisulfite_mismatches(read: Column, ref: Column) -> Column:
    """Places where a read of equal length does not match; without indels."""
    return _of_both(lambda a, b: blocks.differing(a, b, True))(read, ref)


def mismatches(a: Column, b: Column) -> Column:
    """Hamming distance of strings of equal length."""
    return _of_both(blocks.differing)(a, b)


def edit_distance(a: Column, b: Column, most: int) -> Column:
    """Edit distance, -1 beyond ``most``."""
    return _of_both(lambda x, y: blocks.edits(x, y, most))(a, b)


def template_length(start1: Column, end1: Column, start2: Column, end2: Column) -> Column:
    """Bases from the leftmost start to the rightmost end (ends exclusive)."""
    return F.greatest(end1, end2) - F.least(start1, start2)


def last_base(end1: Column, end2: Column) -> Column:
    """Place of the last base of a pair (ends exclusive)."""
    return F.greatest(end1, end2) - 1


def mate_overlap(len1: Column, len2: Column, template: Column) -> Column:
    """Bases that both mates cover."""
    return F.greatest(len1 + len2 - template, F.lit(0))


def mask_overlap(seq: Column, overlap: Column) -> Column:
    """The second mate with its first ``overlap`` bases as N."""
    n = F.least(overlap, F.length(seq))
    return F.when(n > 0, F.concat(F.repeat(F.lit("N"), n.cast("int")), F.substring(seq, n + 1, F.length(seq)))).otherwise(seq)


def cut_id(site: Column, length: int) -> Column:
    """The bucket of a site."""
    return F.floor(site / length).cast("bigint")


def pair_cut_id(site1: Column, site2: Column, length: int) -> Column:
    return cut_id(F.least(site1, site2), length)


def percent(part: Column, total: Column) -> Column:
    """Whole percent, truncated in binary floating point (29 of 100 gives 28); 0 of nothing."""
    return F.when(total > 0, (part.cast("double") / total * 100).cast("int")).otherwise(0)


def phred(qual: Column, base: int = 33) -> Column:
    """Quality values of a quality string."""
    return F.transform(F.filter(F.split(qual, ""), lambda c: c != ""), lambda c: F.ascii(c) - base)


def mismatch_penalty(quality: Column, most: int = 6, least: int = 2) -> Column:
    """The penalty of a mismatch, scaled by its quality up to 40 and truncated."""
    return (F.lit(least) + ((F.least(quality, F.lit(40)) / 40) * (most - least)).cast("int")).cast("int")


def error_limit(length: Column, rate: float = 0.08) -> Column:
    """Errors that a read may have."""
    return F.floor(length * F.lit(rate)).cast("int")


CONTEXTS = ("CpG", "CHG", "CHH")


def context(base: Column, next1: Column, next2: Column, before1: Column, before2: Column) -> Column:
    """Cytosine context on either strand: 0 CpG, 1 CHG, 2 CHH, 3 none.

    The neighbours must come from the same contig. CHH takes what is neither CpG nor CHG, contig ends
    and neighbours that are no base included.
    """
    forward = F.when(next1 == "G", 0).when(next2 == "G", 1).otherwise(2)
    reverse = F.when(before1 == "C", 0).when(before2 == "C", 1).otherwise(2)
    return F.when(base == "C", forward).when(base == "G", reverse).otherwise(3)
