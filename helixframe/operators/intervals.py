"""Interval joins by bins: no nested loops, each pair once.

Intervals are half-open (beg, end). Each is dealt to the bins that it touches; a pair meets in every
bin that both touch and is kept only in the bin of the later start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN = 1 << 14


def _binned(rows: DataFrame, chrom: str, beg: str, end: str, width: int, prefix: str) -> DataFrame:
    bins = F.explode(F.sequence(F.floor(F.col(beg) / width), F.floor((F.greatest(F.col(end), F.col(beg) + 1) - 1) / width)))
    return rows.select(*(F.col(c).alias(prefix + c) for c in rows.columns), F.col(chrom).alias("__chrom"), bins.alias("__bin"))


def overlaps(a_beg: Column, a_end: Column, b_beg: Column, b_end: Column) -> Column:
    return (a_beg < b_end) & (a_end > b_beg)


def overlap_join(left: DataFrame, right: DataFrame, width: int = BIN, chrom: str = "chrom", beg: str = "beg", end: str = "end", prefixes: tuple[str, str] = ("l_", "r_")) -> DataFrame:
    """All overlapping pairs, columns prefixed by side."""
    p, q = prefixes
    both = _binned(left, chrom, beg, end, width, p).join(_binned(right, chrom, beg, end, width, q), ["__chrom", "__bin"])
    once = F.col("__bin") == F.floor(F.greatest(F.col(p + beg), F.col(q + beg)) / width)
    return both.where(overlaps(F.col(p + beg), F.col(p + end), F.col(q + beg), F.col(q + end)) & once).drop("__chrom", "__bin")


def overlap_semi(left: DataFrame, right: DataFrame, width: int = BIN, anti: bool = False, chrom: str = "chrom", beg: str = "beg", end: str = "end") -> DataFrame:
    """Rows of ``left`` that overlap some interval of ``right`` (or none). The regions are merged first, so that a row meets few."""
    regions = merged(right, chrom, beg, end).select(F.col(chrom).alias("__c"), F.col(beg).alias("__b"), F.col(end).alias("__e"))
    near = regions.select("*", F.explode(F.sequence(F.floor(F.col("__b") / width), F.floor((F.col("__e") - 1) / width))).alias("__bin"))
    keyed = left.withColumn("__row", F.struct(*(F.col(c) for c in left.columns)))
    bins = F.sequence(F.floor(F.col(beg) / width), F.floor((F.greatest(F.col(end), F.col(beg) + 1) - 1) / width))
    touched = keyed.select("__row", F.col(chrom).alias("__chrom"), F.col(beg).alias("__beg"), F.col(end).alias("__end"), F.explode(bins).alias("__bin"))
    hit = touched.join(near, (touched["__chrom"] == near["__c"]) & (touched["__bin"] == near["__bin"]) & (F.col("__b") < F.col("__end")) & (F.col("__e") > F.col("__beg")), "left_semi").select("__row").distinct()
    return keyed.join(hit, "__row", "left_anti" if anti else "left_semi").drop("__row")


def _before(rows: DataFrame, chrom: str, of: Column, name: str) -> DataFrame:
    """``chrom, __bin, name``: ``of`` the aggregated bins of a chromosome, gathered over all bins before; only bins meet in a task."""
    bins = Window.partitionBy(chrom).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(chrom, "__bin", of.over(bins).alias(name))


def merged(rows: DataFrame, chrom: str = "chrom", beg: str = "beg", end: str = "end", width: int = BIN) -> DataFrame:
    """The union of the intervals of each chromosome, touching ones joined.

    Islands are found bin by bin; what reaches into a bin from those before is the running maximum
    over the bins, and islands that go on in a later bin carry the place where they began.
    """
    binned = rows.select(chrom, beg, end).withColumn("__bin", F.floor(F.col(beg) / width))
    reaches = _before(binned.groupBy(chrom, "__bin").agg(F.max(end).alias("__end")), chrom, F.max("__end"), "__reach")
    w = Window.partitionBy(chrom, "__bin").orderBy(beg, end)
    reach = F.greatest("__reach", F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    starts = binned.join(reaches, [chrom, "__bin"]).withColumn("__all", reach).withColumn("__new", F.when(F.col("__all").isNull() | (F.col(beg) > F.col("__all")), F.col(beg)))
    began = _before(starts.groupBy(chrom, "__bin").agg(F.max("__new").alias("__last")), chrom, F.max("__last"), "__began")
    islands = starts.join(began, [chrom, "__bin"]).withColumn("__island", F.coalesce(F.max("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)), "__began"))
    return islands.groupBy(chrom, "__island").agg(F.max(end).alias(end)).select(chrom, F.col("__island").alias(beg), end)


def coverage(rows: DataFrame, chrom: str = "chrom", beg: str = "beg", end: str = "end", width: int = BIN) -> DataFrame:
    """``chrom, beg, end, depth``: maximal segments of equal positive depth, by a running sum over ends, bin by bin with what the bins before leave open."""
    steps = rows.select(chrom, F.col(beg).alias("at"), F.lit(1).alias("d")).unionByName(rows.select(chrom, F.col(end).alias("at"), F.lit(-1).alias("d")))
    changes = steps.groupBy(chrom, "at").agg(F.sum("d").alias("d")).where("d <> 0").withColumn("__bin", F.floor(F.col("at") / width))
    bins = changes.groupBy(chrom, "__bin").agg(F.sum("d").alias("__sum"), F.min("at").alias("__first"))
    over = Window.partitionBy(chrom).orderBy("__bin")
    carried = bins.select(chrom, "__bin", F.coalesce(F.sum("__sum").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__open"), F.lead("__first").over(over).alias("__next"))
    w = Window.partitionBy(chrom, "__bin").orderBy("at")
    depth = F.col("__open") + F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0))
    found = changes.join(carried, [chrom, "__bin"]).withColumn("depth", depth).withColumn("until", F.coalesce(F.lead("at").over(w), F.col("__next")))
    return found.where("depth > 0").select(chrom, F.col("at").alias(beg), F.col("until").alias(end), "depth")


def band_join(left: DataFrame, right: DataFrame, key: list[str], at: tuple[str, str], low: int, high: int) -> DataFrame:
    """Pairs of equal key with ``low <= right.at - left.at <= high``, dealt by bins of the band's width as well as the key."""
    width = max(1, high - low + 1)
    a, b = at
    near = left.withColumn("__bin", F.explode(F.sequence(F.floor((F.col(a) + low) / width), F.floor((F.col(a) + high) / width))))
    return near.join(right.withColumn("__bin", F.floor(F.col(b) / width)), [*key, "__bin"]).where((F.col(b) - F.col(a)).between(low, high)).drop("__bin")


def region(text: Column) -> Column:
    """``struct<chrom, beg, end>`` of ``name:from-to`` (1-based, inclusive, commas allowed); open ends reach 2**31 - 1, a bare name takes all."""
    bare = F.regexp_replace(text, ",", "")
    ranged = bare.rlike(r"^.+:[0-9]+(-[0-9]*)?$")
    first = F.regexp_extract(bare, r":([0-9]+)(?:-[0-9]*)?$", 1).try_cast("bigint")
    last = F.regexp_extract(bare, r":[0-9]+-([0-9]+)$", 1).try_cast("bigint")
    most = F.lit(2**31 - 1).cast("bigint")
    return F.struct(F.when(ranged, F.regexp_extract(bare, r"^(.+):[0-9]+(?:-[0-9]*)?$", 1)).otherwise(text).alias("chrom"), F.when(ranged, F.greatest(first - 1, F.lit(0))).otherwise(F.lit(0)).cast("bigint").alias("beg"), F.when(ranged, F.coalesce(last, most)).otherwise(most).alias("end"))


def bins_of(beg: Column, end: Column, width: int = BIN) -> Column:
    """The bins of a range, to state next to a predicate on positions where data is stored by bin."""
    return F.sequence(F.floor(beg / width), F.floor((end - 1) / width))
