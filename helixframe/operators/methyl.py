"""Methylation: duplicates, counts by position, variant evidence, bedGraph rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions import blocks, dna
from helixframe.operators import context


def first_of(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row of each key: the first by ``order``. Partial minima, no sorted window."""
    rest = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.min(F.struct(*order, *(c for c in rest if c not in order))).alias("__first"))
    return best.select(*(F.col(c) if c in key else F.col(f"__first.{c}").alias(c) for c in rows.columns))


def without_duplicates(alignments: DataFrame) -> DataFrame:
    """Reads of equal contig, strand, site and template count once: the first by name."""
    return first_of(alignments, ["chrom_id", "strand", "site", "tlen"], ["name"])


def counts(alignments: DataFrame, contigs: DataFrame, size: int = context.CHUNK) -> DataFrame:
    """``chrom_id, name, pos, context, methylated, total, variant, opposite, depth`` of the cytosines that ungapped reads cover.

    Sequences are as the forward strand shows them. A C of the reference is read on strand 0 (C
    methylated, T not), a G on strand 1 (G methylated, A not). Other bases of that strand are variant
    evidence, and ``opposite`` counts the other strand's bases that differ from the reference. Reads go
    to the pieces they lie on, sorted behind them, and are counted as they stream by: a base never becomes a row.
    """
    names = contigs.select("chrom_id", "name")
    pieces = context.around(contigs, size, ["name"]).select("chrom_id", F.floor(F.col("pos") / size).cast("bigint").alias("piece"), F.lit(-1).alias("strand"), F.col("pos").cast("bigint").alias("pos"), "ahead", "n", "text", "name")
    last = F.floor((F.col("site") + F.length("seq") - 1) / size)
    reads = alignments.where("seq <> ''").select("chrom_id", F.explode(F.sequence(F.floor(F.col("site") / size).cast("bigint"), last.cast("bigint"))).alias("piece"), F.col("strand").cast("int").alias("strand"), F.col("site").cast("bigint").alias("pos"), F.lit(0).alias("ahead"), F.lit(0).alias("n"), F.col("seq").alias("text"), F.lit(None).cast("string").alias("name"))
    both = pieces.unionByName(reads).repartition("chrom_id", "piece").sortWithinPartitions("chrom_id", "piece", "strand")
    columns = ["chrom_id", "name", "pos", "context", "methylated", "total", "variant", "opposite", "depth"]
    schema = f"chrom_id {names.schema['chrom_id'].dataType.simpleString()}, name string, pos int, context int, " + ", ".join(f"{c} bigint" for c in columns[4:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, before = None, None  # the last piece, whose reads may go on, and its counts
        for part in (p for b in batches for p in blocks.parts(b, "text", 4 * blocks.PART)):
            rows = part if kept is None else pa.concat_batches([kept, part])
            strand = rows.column("strand").to_numpy()
            of = np.cumsum(strand < 0) - 1
            at = np.flatnonzero(strand < 0)
            if not len(at):
                continue
            ours = (strand >= 0) & (of >= 0)
            for c in ("chrom_id", "piece"):  # reads of no contig lie behind another one's piece
                ids = rows.column(c)
                ours &= pc.fill_null(pc.equal(ids, ids.take(pa.array(at[np.maximum(of, 0)]))), False).to_numpy(zero_copy_only=False)
            pieces = rows.take(pa.array(at))
            first, ahead, n = (pieces.column(c).to_numpy().astype(np.int64) for c in ("pos", "ahead", "n"))
            start = np.cumsum(n) - n
            data, begin = blocks.flat(pieces.column("text"), "\n\n")
            inner = np.arange(n.sum()) - np.repeat(start, n)
            place = np.repeat(begin[:-1] + ahead, n) + inner
            ref, kind = data[place], blocks.contexts(data)[place]
            some = np.flatnonzero(ours)
            bases, where = blocks.flat(rows.column("text").take(pa.array(some)))
            length = np.diff(where)
            to = np.repeat(rows.column("pos").to_numpy()[some] - first[of[some]], length) + np.arange(len(bases)) - np.repeat(where[:-1], length)
            inside = (to >= 0) & (to < np.repeat(n[of[some]], length))
            to = (to + np.repeat(start[of[some]], length))[inside]
            seen = np.bincount((to * 2 + np.repeat(strand[some], length)[inside]) * 5 + blocks.codes(bases[inside]), minlength=10 * len(ref)).reshape(-1, 2, 5)
            if before is not None:
                seen[: len(before)] += before
            done = len(ref) - int(n[-1])
            kept, before = pieces.slice(len(at) - 1), seen[done:]
            yield from told(pieces, np.repeat(np.arange(len(at)), n)[:done], (np.repeat(first, n) + inner)[:done], ref[:done], kind[:done], seen[:done])
        if kept is not None:
            n = kept.column("n").to_numpy().astype(np.int64)
            data, ahead = blocks.flat(kept.column("text"), "\n\n")[0], int(kept.column("ahead")[0].as_py())
            inner = np.arange(n[0])
            yield from told(kept, inner * 0, int(kept.column("pos")[0].as_py()) + inner, data[ahead + inner], blocks.contexts(data)[ahead + inner], before)

    def told(pieces: pa.RecordBatch, row: np.ndarray, pos: np.ndarray, ref: np.ndarray, kind: np.ndarray, seen: np.ndarray) -> Iterator[pa.RecordBatch]:
        depth = seen.sum(axis=(1, 2))
        at = np.flatnonzero((kind < 3) & (depth > 0))
        for some in np.split(at, range(1 << 17, len(at), 1 << 17)):
            reverse = (ref[some] == ord("G")).astype(np.int64)
            i = np.arange(len(some))
            own, other = seen[some, reverse], seen[some, 1 - reverse]
            base, turned = np.where(reverse, 2, 1), np.where(reverse, 0, 3)
            methylated, total = own[i, base], own[i, base] + own[i, turned]
            numbers = [methylated, total, own.sum(axis=1) - total, other.sum(axis=1) - other[i, base], depth[some]]
            of = pa.array(row[some])
            yield pa.RecordBatch.from_arrays([pieces.column("chrom_id").take(of), pieces.column("name").take(of), pa.array(pos[some].astype(np.int32)), pa.array(kind[some].astype(np.int32)), *(pa.array(x.astype(np.int64)) for x in numbers)], names=columns)

    return both.mapInArrow(run, schema)


def without_variants(counted: DataFrame, max_fraction: float = 0.0, min_depth: int = 65536) -> DataFrame:
    """Sites that are not deep enough to judge, or whose share of variant evidence is small enough."""
    evidence = F.col("variant") + F.col("opposite")
    return counted.where(~((F.col("depth") >= min_depth) & (evidence / F.col("depth") > max_fraction)))


def bedgraph(counted: DataFrame, contexts: tuple[str, ...] = ("CpG",)) -> DataFrame:
    """``context, chrom, beg, end, pct, n_meth, n_unmeth`` of the contexts asked for."""
    wanted = [dna.CONTEXTS.index(c) for c in contexts]
    names = F.element_at(F.array(*map(F.lit, dna.CONTEXTS)), F.col("context") + 1)
    rows = counted.where(F.col("context").isin(wanted) & (F.col("total") > 0))
    return rows.select(names.alias("context"), F.col("name").alias("chrom"), F.col("pos").alias("beg"), (F.col("pos") + 1).alias("end"), dna.percent(F.col("methylated"), F.col("total")).alias("pct"), F.col("methylated").alias("n_meth"), (F.col("total") - F.col("methylated")).alias("n_unmeth"))


def cut_counts(alignments: DataFrame, length: int, site: Column | None = None) -> DataFrame:
    """``cut_id, n``: records of each bucket of the coordinate."""
    return alignments.groupBy(dna.cut_id(F.col("site") if site is None else site, length).alias("cut_id")).agg(F.count("*").alias("n"))


def insert_sizes(pairs: DataFrame, length: int) -> DataFrame:
    """``cut_id, tlen, n``: the histogram of template lengths by bucket."""
    return pairs.groupBy(dna.pair_cut_id(F.col("start1"), F.col("start2"), length).alias("cut_id"), "tlen").agg(F.count("*").alias("n"))


def extraction_counters(alignments: DataFrame) -> DataFrame:
    """``n_total, n_unique, n_duplicate, n_abnormal``: one row. Abnormal reads hold bases other than A, C, G, T, N."""
    key = ["chrom_id", "strand", "site", "tlen"]
    bad = F.count(F.when(F.col("seq").rlike("[^ACGTN]"), 1))
    groups = alignments.groupBy(*key).agg(F.count("*").alias("n"), bad.alias("bad"))
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_total"), F.count("*").alias("n_unique"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicate"), F.coalesce(F.sum("bad"), F.lit(0)).alias("n_abnormal"))


def pair_calls_once(seq2: Column, len1: Column, len2: Column, template: Column) -> Column:
    """The second mate with what the first covers already as N."""
    return dna.mask_overlap(seq2, dna.mate_overlap(len1, len2, template))


def sites_by_pair(pairs: DataFrame) -> DataFrame:
    """Rank of pairs by fragment, for keeping the first of duplicates."""
    w = Window.partitionBy("chrom_id", "strand", "start1", "tlen").orderBy("pair_id")
    return pairs.withColumn("copy", F.row_number().over(w))
