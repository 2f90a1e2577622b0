"""Readers of text formats.

Formats whose records are lines, or are set apart by a fixed string, are read by Spark's own text
source, which splits files and works with any store. All coordinates come out 0-based and half-open.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import cigar, dna, variant

#: Columns of the tab-delimited formats: chromosome, begin, end (0 if none), comment sign, whether begin counts from 0.
PRESETS = {"bed": (1, 2, 3, "#", True), "gff": (1, 4, 5, "#", False), "vcf": (1, 2, 0, "#", False), "sam": (3, 4, 0, "@", False), "psl": (15, 17, 18, "#", True)}


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """``name, seq``: names up to the first blank, bases in upper case without white space. Text before the first record is left out."""
    rows = spark.read.option("lineSep", "\n>").text(path).withColumn("value", F.regexp_replace("value", "^>", ""))
    head = F.regexp_extract("value", r"^([^\r\n]*)", 1)
    body = F.substring("value", F.length(head) + 1, F.length("value"))
    return rows.where(F.trim("value") != "").select(F.regexp_extract(head, r"^(\S*)", 1).alias("name"), dna.normalised(body).alias("seq"))


def fasta_index(contigs: DataFrame) -> DataFrame:
    """``name, length`` of each sequence."""
    return contigs.select("name", F.length("seq").cast("bigint").alias("length"))


def sequence_count(contigs: DataFrame) -> DataFrame:
    return contigs.agg(F.count("*").alias("n_sequences"), F.coalesce(F.sum(F.length("seq")), F.lit(0)).cast("bigint").alias("n_bases"))


def lines(spark: SparkSession, path: str, comment: str = "#") -> DataFrame:
    """The fields of the lines that are neither empty nor comments."""
    rows = spark.read.text(path).where((F.trim("value") != "") & ~F.col("value").startswith(comment))
    return rows.select(F.split(F.regexp_replace("value", "\r$", ""), "\t").alias("f"))


def delimited(spark: SparkSession, path: str, preset: str | tuple[int, int, int, str, bool]) -> DataFrame:
    """``chrom, beg, end, fields`` of a tab-delimited format, by a preset or by columns."""
    chrom, beg, end, comment, zero = PRESETS[preset] if isinstance(preset, str) else preset
    f = F.col("f")
    first = F.get(f, F.lit(beg - 1)).cast("bigint") - (0 if zero else 1)
    last = F.get(f, F.lit(end - 1)).cast("bigint") if end else first + 1
    return lines(spark, path, comment).select(F.get(f, F.lit(chrom - 1)).alias("chrom"), first.alias("beg"), last.alias("end"), f.alias("fields"))


def bed(spark: SparkSession, path: str) -> DataFrame:
    """``chrom, beg, end, name, score, strand``; browser and track lines are left out, a missing end means one base."""
    f = F.col("f")
    rows = lines(spark, path).where(~F.get(f, F.lit(0)).rlike("^(track|browser)"))
    beg = F.get(f, F.lit(1)).cast("bigint")
    return rows.select(F.get(f, F.lit(0)).alias("chrom"), beg.alias("beg"), F.coalesce(F.get(f, F.lit(2)).cast("bigint"), beg + 1).alias("end"), F.get(f, F.lit(3)).alias("name"), F.get(f, F.lit(4)).alias("score"), F.get(f, F.lit(5)).alias("strand"))


def regions(spark: SparkSession, path: str) -> DataFrame:
    """``chrom, beg, end`` of 1-based inclusive tab-separated regions; a missing end means one base."""
    f = F.col("f")
    beg = F.get(f, F.lit(1)).cast("bigint")
    return lines(spark, path).select(F.get(f, F.lit(0)).alias("chrom"), (beg - 1).alias("beg"), F.coalesce(F.get(f, F.lit(2)).cast("bigint"), beg).alias("end"))


def gff(spark: SparkSession, path: str) -> DataFrame:
    """``chrom, source, feature, beg, end, score, strand, frame, attributes`` (a map)."""
    f = F.col("f")
    pairs = F.filter(F.split(F.get(f, F.lit(8)), r";\s*"), lambda p: F.contains(p, F.lit("=")))
    attributes = F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.substring(p, F.instr(p, "=") + 1, F.length(p)).alias("v"))))
    return lines(spark, path).select(F.get(f, F.lit(0)).alias("chrom"), F.get(f, F.lit(1)).alias("source"), F.get(f, F.lit(2)).alias("feature"), (F.get(f, F.lit(3)).cast("bigint") - 1).alias("beg"), F.get(f, F.lit(4)).cast("bigint").alias("end"), F.get(f, F.lit(5)).try_cast("double").alias("score"), F.get(f, F.lit(6)).alias("strand"), F.get(f, F.lit(7)).alias("frame"), attributes.alias("attributes"))


def sam_header(spark: SparkSession, path: str) -> DataFrame:
    """``kind, fields`` of the header lines; fields map two-letter tags to values."""
    rows = spark.read.text(path).where(F.col("value").rlike("^@[A-Z]{2}(\t|$)"))
    parts = F.filter(F.split("value", "\t"), lambda p: p.rlike("^[A-Za-z][A-Za-z0-9]:"))
    return rows.select(F.substring("value", 2, 2).alias("kind"), F.map_from_entries(F.transform(parts, lambda p: F.struct(F.substring(p, 1, 2).alias("k"), F.substring(p, F.lit(4), F.length(p)).alias("v")))).alias("fields"))


def sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignment records: the eleven columns, positions 0-based (-1 if none), and a map of optional fields."""
    f = F.col("f")
    rows = spark.read.text(path).where((F.trim("value") != "") & ~F.col("value").rlike("^@[A-Z]{2}(\t|$)")).select(F.split(F.regexp_replace("value", "\r$", ""), "\t").alias("f")).where(F.size("f") >= 11)
    text = lambda i, n: F.get(f, F.lit(i)).alias(n)
    number = lambda i, n, d=0: (F.get(f, F.lit(i)).cast("int") - d).alias(n)
    return rows.select(text(0, "qname"), number(1, "flag"), text(2, "rname"), number(3, "pos", 1), number(4, "mapq"), text(5, "cigar"), text(6, "rnext"), number(7, "pnext", 1), number(8, "tlen"), text(9, "seq"), text(10, "qual"), cigar.tags(F.slice(f, 12, 1 << 30)).alias("tags"))


def vcf_header(spark: SparkSession, path: str) -> DataFrame:
    """``kind, id, number, type, line`` of the header's structured lines."""
    rows = spark.read.text(path).where(F.col("value").rlike(r"^##\w+=<"))
    part = lambda n: F.nullif(F.regexp_extract("value", rf"[<,]{n}=([^,>]*)", 1), F.lit(""))
    return rows.select(F.regexp_extract("value", r"^##(\w+)=", 1).alias("kind"), part("ID").alias("id"), part("Number").alias("number"), part("Type").alias("type"), F.col("value").alias("line"))


def vcf_samples(spark: SparkSession, path: str) -> list[str]:
    """The sample names of the header line."""
    row = spark.read.text(path).where(F.col("value").startswith("#CHROM\t")).first()
    return row["value"].rstrip("\r").split("\t")[9:] if row else []


def vcf(spark: SparkSession, path: str, samples: list[int] | None = None) -> DataFrame:
    """``chrom, pos, id, ref, alts, qual, filters, info, format, samples`` (texts); with ``samples`` only those places."""
    f = F.col("f")
    rows = lines(spark, path)
    every = F.slice(f, 10, 1 << 30)
    shown = every if samples is None else variant.subset(every, samples)
    alts = F.filter(F.split(F.get(f, F.lit(4)), ","), lambda a: a != ".")
    filters = F.filter(F.split(F.get(f, F.lit(6)), ";"), lambda x: x != ".")
    return rows.select(F.get(f, F.lit(0)).alias("chrom"), (F.get(f, F.lit(1)).cast("bigint") - 1).alias("pos"), F.get(f, F.lit(2)).alias("id"), F.get(f, F.lit(3)).alias("ref"), alts.alias("alts"), F.get(f, F.lit(5)).try_cast("double").alias("qual"), filters.alias("filters"), variant.info(F.get(f, F.lit(7))).alias("info"), F.get(f, F.lit(8)).alias("format"), F.when(F.size(f) > 9, shown).otherwise(F.array().cast("array<string>")).alias("samples"))


def kind_of(path: str) -> str:
    """The format that a file's name tells."""
    bare = path.lower().removesuffix(".gz").removesuffix(".bgz")
    kinds = {"fastq": (".fq", ".fastq"), "fasta": (".fa", ".fasta", ".fna"), "sam": (".sam",), "bam": (".bam",), "vcf": (".vcf",), "bed": (".bed",), "gff": (".gff", ".gff3", ".gtf"), "bedgraph": (".bedgraph", ".bg")}
    for kind, ends in kinds.items():
        if bare.endswith(ends):
            return kind
    raise ValueError(f"{path}: no format of this library has this extension")
