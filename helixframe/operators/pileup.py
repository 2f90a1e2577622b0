"""Pileups: reads by reference position."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions import cigar

DEPTH = 8000


def columns(records: DataFrame, most: int | None = DEPTH) -> DataFrame:
    """``rname, pos, qname, qpos, base, qual, is_del, is_refskip, indel, is_head, is_tail`` for usable records (``pos`` 0-based).

    Of reads that start at one place at most ``most`` take part, in the order of their names: the
    depth limit is a feature of pileups; None takes all.
    """
    rows = records.where(cigar.usable(F.col("flag")) & (cigar.reference_length(F.col("cigar")) > 0))
    if most is not None:
        w = Window.partitionBy("rname", "pos").orderBy("qname", "flag")
        rows = rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")
    shown = rows.select("rname", "qname", "flag", F.col("qual").alias("quals"), F.explode(cigar.columns(F.col("pos"), F.col("cigar"), F.col("seq"))).alias("c"))
    quality = F.when(F.col("quals") != "*", F.ascii(F.substring("quals", F.col("c.qpos") + 1, F.lit(1))) - 33)
    return shown.select("rname", "qname", "flag", "c.*", quality.alias("qual"))


def depth(piled: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``rname, pos, depth, n_a, n_c, n_g, n_t, n_del``, of each source where ``by`` names one."""
    n = lambda b: F.count(F.when(F.upper("base") == b, 1))
    return piled.where("not is_refskip").groupBy(*(by or []), "rname", "pos").agg(F.count("*").alias("depth"), n("A").alias("n_a"), n("C").alias("n_c"), n("G").alias("n_g"), n("T").alias("n_t"), F.count(F.when(F.col("is_del"), 1)).alias("n_del"))


def text(piled: DataFrame) -> DataFrame:
    """``rname, pos, depth, bases``: a line for each place, bases in the order of the reads' names; ``-`` in deletions, ``>`` in skips, insertions as ``+n``."""
    mark = F.when(F.col("is_refskip"), ">").when(F.col("is_del"), "-").otherwise(F.col("base"))
    more = F.when(F.col("indel") > 0, F.concat(F.lit("+"), F.col("indel"))).when(F.col("indel") < 0, F.col("indel").cast("string")).otherwise("")
    one = F.struct("qname", "flag", F.concat(mark, more).alias("m"))
    return piled.groupBy("rname", "pos").agg(F.count("*").alias("depth"), F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["m"]), "").alias("bases"))


def merged_overlaps(piled: DataFrame) -> DataFrame:
    """Mates that overlap, by name and place: equal bases give the first both qualities (200 at most) and the second none; else the better keeps 0.8 of its own, truncated, the other none, ties to the first."""
    w = Window.partitionBy("rname", "pos", "qname")
    two = piled.withColumn("__n", F.row_number().over(w.orderBy("flag"))).withColumn("__of", F.count("*").over(w)).withColumn("__q1", F.first("qual").over(w.orderBy("flag").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).withColumn("__q2", F.last("qual").over(w.orderBy("flag").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).withColumn("__same", F.min("base").over(w) == F.max("base").over(w))
    first, q1, q2 = F.col("__n") == 1, F.col("__q1"), F.col("__q2")
    equal = F.when(first, F.least(q1 + q2, F.lit(200))).otherwise(0)
    unequal = F.when(first & (q1 >= q2), (q1 * 0.8).cast("int")).when(~first & (q2 > q1), (q2 * 0.8).cast("int")).otherwise(0)
    joined = (F.col("__of") == 2) & ~F.col("is_del")
    return two.withColumn("qual", F.when(joined, F.when(F.col("__same"), equal).otherwise(unequal)).otherwise(F.col("qual")).cast("int")).drop("__n", "__of", "__q1", "__q2", "__same")


def mates(records: DataFrame) -> DataFrame:
    """Pairs of records of one name that are proper, both mapped, and whose template is shorter than twice the read."""
    fit = records.where(cigar.has(F.col("flag"), 0x2) & ~cigar.has(F.col("flag"), 0x8) & (F.abs("tlen") < 2 * F.length("seq")))
    a = fit.where(cigar.has(F.col("flag"), 0x40)).select(F.col("qname"), F.col("rname"), F.col("pos").alias("pos1"), F.col("cigar").alias("cigar1"))
    b = fit.where(cigar.has(F.col("flag"), 0x80)).select(F.col("qname"), F.col("rname"), F.col("pos").alias("pos2"), F.col("cigar").alias("cigar2"))
    return a.join(b, ["qname", "rname"])
