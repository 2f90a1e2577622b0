"""Column functions over variants and genotypes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of a variant's types; 0 is the reference.
SNP, MNP, INDEL, OTHER, BREAKEND = 1, 2, 4, 8, 16
#: Genotype types by number.
GENOTYPES = ("hom_ref", "hom_alt", "het_ref_alt", "het_alt_alt", "haploid_ref", "haploid_alt", "unknown")


def _shared(a: Column, b: Column) -> Column:
    """Length of the common prefix."""
    n = F.least(F.length(a), F.length(b))
    differ = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    return F.when(n == 0, 0).when(F.size(differ) > 0, F.element_at(differ, 1) - 1).otherwise(n)


def variant_type(ref: Column, alt: Column) -> Column:
    """``struct<type, n>`` of one alternative: the type's bit, and for indels the length (negative for deletions), else the bases that differ."""
    a, b = F.upper(ref), F.upper(alt)
    symbolic = alt.rlike("^<.*>$") | alt.isin("*")
    bracket = alt.rlike(r"[\[\]]")
    none = alt.isNull() | alt.isin(".", "<*>", "<X>", "<NON_REF>", "") | (a == b)
    longer = F.length(b) - F.length(a)
    differ = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x == y, 0).otherwise(1)), F.lit(0), lambda s, x: s + x)
    prefix = _shared(a, b)
    suffix = F.least(_shared(F.reverse(a), F.reverse(b)), F.least(F.length(a), F.length(b)) - prefix)
    clean = prefix + suffix >= F.least(F.length(a), F.length(b))
    kind = F.when(none, 0).when(bracket, BREAKEND).when(symbolic, OTHER).when((longer == 0) & (differ == 1), SNP).when(longer == 0, MNP).when(clean, INDEL).otherwise(OTHER)
    n = F.when(none, 0).when(bracket | symbolic, 0).when(longer == 0, differ).otherwise(longer)
    return F.struct(kind.alias("type"), n.alias("n"))


def site_types(ref: Column, alts: Column) -> Column:
    """The types of all alternatives, as bits."""
    return F.aggregate(alts, F.lit(0), lambda s, x: s.bitwiseOR(variant_type(ref, x)["type"]))


def genotype_type(gt: Column) -> Column:
    """Number in ``GENOTYPES`` of an array of allele numbers (null or negative: missing)."""
    known = F.filter(gt, lambda g: g >= 0)
    missing = (F.size(gt) == 0) | (F.size(known) < F.size(gt))
    different = F.size(F.array_distinct(known)) > 1
    ref = F.array_contains(known, 0)
    haploid = F.size(gt) == 1
    return F.when(missing, 6).when(haploid & ref, 4).when(haploid, 5).when(different & ref, 2).when(different, 3).when(ref, 0).otherwise(1)


def diploid_index(i: Column, j: Column) -> Column:
    """Place of a genotype in lists of all of them."""
    hi = F.greatest(i, j)
    return (hi * (hi + 1) / 2).cast("int") + F.least(i, j)


def has_filter(filters: Column, name: str) -> Column:
    """Whether a filter is set; an empty list counts as ``.``, and ``PASS`` and ``.`` mean each other."""
    empty = (F.size(filters) == 0)
    if name in (".", "PASS"):
        return empty | F.array_contains(filters, "PASS") | F.array_contains(filters, ".")
    return F.array_contains(filters, name)


def add_filter(filters: Column, name: str) -> Column:
    """The filters with one more; ``PASS`` replaces all others, and any other replaces ``PASS``."""
    if name == "PASS":
        return F.array(F.lit("PASS"))
    return F.array_union(F.array_remove(filters, "PASS"), F.array(F.lit(name)))


def remove_filter(filters: Column, name: str) -> Column:
    return F.array_remove(filters, name)


def info(text: Column) -> Column:
    """A map of an INFO column; flags map to the empty string, ``.`` is empty."""
    parts = F.filter(F.split(text, ";"), lambda p: (p != "") & (p != "."))
    entries = F.transform(parts, lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.when(F.contains(p, F.lit("=")), F.substring(p, F.instr(p, "=") + 1, F.length(p))).otherwise("").alias("v")))
    return F.map_from_entries(entries)


def info_numbers(values: Column) -> Column:
    """The comma-separated numbers of an INFO value; ``.`` is null."""
    return F.transform(F.split(values, ","), lambda x: x.try_cast("double"))


def set_info(fields: Column, name: str, value: Column) -> Column:
    return F.map_concat(F.map_filter(fields, lambda k, _: k != name), F.create_map(F.lit(name), value.cast("string")))


def sample_value(format_: Column, sample: Column, name: str) -> Column:
    """A sample's value of a FORMAT key; null if absent."""
    at = F.array_position(F.split(format_, ":"), name).cast("int")
    return F.when(at > 0, F.get(F.split(sample, ":"), at - 1))


def genotype(value: Column) -> Column:
    """Allele numbers of a GT value; missing ones are -1."""
    return F.transform(F.split(value, r"[/|]"), lambda x: F.coalesce(x.try_cast("int"), F.lit(-1)))


def subset(samples: Column, wanted: list[int]) -> Column:
    """The samples at these places, in that order."""
    return F.transform(F.array(*map(F.lit, wanted)), lambda i: F.get(samples, i))


def used_alleles(alts: Column, gts: Column) -> Column:
    """Numbers (from 1) of the alternatives that some genotype shows."""
    shown = F.array_distinct(F.flatten(gts))
    return F.filter(F.sequence(F.lit(1), F.greatest(F.size(alts), F.lit(1))), lambda i: (i <= F.size(alts)) & F.array_contains(shown, i))


def kept_alleles(alts: Column, keep: Column) -> Column:
    return F.transform(keep, lambda i: F.element_at(alts, i))


def renumbered(gt: Column, keep: Column) -> Column:
    """A genotype after all alternatives but ``keep`` are gone; genotypes of removed ones become missing."""
    return F.transform(gt, lambda g: F.when(g <= 0, g).when(F.array_contains(keep, g), F.array_position(keep, g).cast("int")).otherwise(-1))


def record_problem(pos: Column, ref: Column, alts: Column, gts: Column) -> Column:
    """What is wrong with a record, null if nothing."""
    bad_gt = F.exists(gts, lambda g: g > F.size(alts))
    return F.when(pos < 0, "negative position").when(F.length(ref) == 0, "no reference allele").when(F.exists(alts, lambda a: F.length(a) == 0), "empty alternative").when(bad_gt, "genotype beyond the alleles")
