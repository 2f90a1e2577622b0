"""Variant sets: allele counts and synchronised merges of several sources."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions import variant


def allele_counts(rows: DataFrame, key: list[str], gts: str = "gts", n_alts: str = "n_alts") -> DataFrame:
    """``key..., an, ac``: called alleles and how often each alternative is among them."""
    called = F.filter(F.col(gts), lambda g: g >= 0)
    ac = F.transform(F.sequence(F.lit(1), F.col(n_alts)), lambda a: F.size(F.filter(F.col(gts), lambda g: g == a)))
    return rows.select(*key, F.size(called).alias("an"), ac.alias("ac"))


#: How records of one place are paired across sources.
PAIRING = ("exact", "snps", "indels", "any", "snp_ref", "indel_ref", "some")


def pair_key(ref, alts, mode: str):
    """What records must share, besides the place, to become one row; ``some`` pairs by any shared allele instead."""
    types = variant.site_types(ref, alts)
    exact = F.concat_ws(",", ref, F.array_sort(alts))
    snp, indel = types.bitwiseAND(variant.SNP | variant.MNP) != 0, types.bitwiseAND(variant.INDEL) != 0
    if mode == "exact":
        return exact
    if mode == "any":
        return F.lit("any")
    if mode == "snps":
        return F.when(snp, "snp").otherwise(exact)
    if mode == "indels":
        return F.when(indel, "indel").otherwise(exact)
    if mode == "snp_ref":
        return F.when(snp | (types == 0), "snp").otherwise(exact)
    if mode == "indel_ref":
        return F.when(indel | (types == 0), "indel").otherwise(exact)
    raise ValueError(f"mode must be one of {PAIRING}")


def synced(rows: DataFrame, n_sources: int, mode: str = "exact", chrom: str = "chrom", pos: str = "pos", source: str = "source") -> DataFrame:
    """The full outer merge of sources on place and pairing key: ``chrom, pos, pair, sources`` with a record's alleles by source.

    Of several records of one source under one key the least by alleles stands; sources are numbered
    from 1. One shuffle for any number of sources.
    """
    if mode == "some":
        return synced_by_shared_allele(rows, n_sources, chrom, pos, source)
    own = F.struct(F.col("ref"), F.array_join(F.array_sort("alts"), ",").alias("alts"))
    each = [F.min(F.when(F.col(source) == i + 1, own)) for i in range(n_sources)]
    return rows.withColumn("pair", pair_key(F.col("ref"), F.col("alts"), mode)).groupBy(chrom, pos, "pair").agg(F.array(*(F.when(e.isNotNull(), F.concat(e["ref"], F.lit(">"), e["alts"])) for e in each)).alias("sources"))


def synced_by_shared_allele(rows: DataFrame, n_sources: int, chrom: str, pos: str, source: str) -> DataFrame:
    """Greedy pairing within a place: records join the row with which they share most alleles, sources in order."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        groups: list[tuple[set, list]] = []
        for r in frame.sort_values(["source", "label"]).itertuples(index=False):
            mine = set(r.label.split(">")[1].split(","))
            free = [(len(mine & alleles), -i) for i, (alleles, held) in enumerate(groups) if held[r.source - 1] is None and mine & alleles and r.label.split(">")[0] == next(h for h in held if h).split(">")[0]]
            if free:
                alleles, held = groups[-max(free)[1]]
                alleles |= mine
            else:
                held = [None] * n_sources
                groups.append((mine, held))
            held[r.source - 1] = r.label
        first = frame.iloc[0]
        return pd.DataFrame([(first["chrom"], first["pos"], next(h for h in held if h), held) for _, held in groups], columns=["chrom", "pos", "pair", "sources"])

    label = F.concat("ref", F.lit(">"), F.array_join(F.array_sort("alts"), ","))
    keyed = rows.select(F.col(chrom).cast("string").alias("chrom"), F.col(pos).cast("bigint").alias("pos"), F.col(source).cast("int").alias("source"), label.alias("label")).distinct()
    return keyed.groupBy("chrom", "pos").applyInPandas(run, "chrom string, pos bigint, pair string, sources array<string>")


def union_of(frames: list[DataFrame]) -> DataFrame:
    """Rows of all sources under the union of their columns."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def swept(rows: DataFrame, backward: bool = False, chrom: str = "chrom", pos: str = "pos") -> DataFrame:
    """Records in the order of their places, forwards or backwards."""
    order = [F.desc(c) if backward else F.asc(c) for c in (chrom, pos)]
    return rows.orderBy(*order)


def trimmed(rows: DataFrame) -> DataFrame:
    """Records without alternatives that no genotype shows (``alts``, ``gts`` as one list of allele numbers), genotypes renumbered."""
    keep = variant.used_alleles(F.col("alts"), F.array("gts"))
    return rows.withColumn("__keep", keep).withColumn("alts", variant.kept_alleles(F.col("alts"), F.col("__keep"))).withColumn("gts", variant.renumbered(F.col("gts"), F.col("__keep"))).drop("__keep")


