"""Writers of text formats through Spark's text sink, one file a partition, committed by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions import cigar

VERSION = "0.1"


def sam_header(contigs: list[tuple[str, int]], command: str = "") -> str:
    """The header: version, contigs (name, length), program."""
    rows = ["@HD\tVN:1.4\tSO:unsorted", *(f"@SQ\tSN:{n}\tLN:{length}" for n, length in contigs), f"@PG\tID:helixframe\tVN:{VERSION}" + (f"\tCL:{command}" if command else "")]
    return "\n".join(rows) + "\n"


def sam_lines(records: DataFrame) -> DataFrame:
    """``value``: a line for each record; positions become 1-based."""
    fields = ["qname", "flag", "rname", F.col("pos") + 1, "mapq", "cigar", "rnext", F.col("pnext") + 1, "tlen", "seq", "qual"]
    tags = cigar.tag_text(F.coalesce(F.col("tags"), F.map_from_entries(F.array().cast("array<struct<k:string,v:struct<type:string,value:string>>>"))))
    return records.select(F.concat(F.concat_ws("\t", *(F.col(f).cast("string") if isinstance(f, str) else f.cast("string") for f in fields)), F.when(tags != "", F.concat(F.lit("\t"), tags)).otherwise("")).alias("value"))


def write_sam(records: DataFrame, path: str, contigs: list[tuple[str, int]], mode: str = "errorifexists", command: str = "") -> None:
    """SAM files with the header in each, so that every file stands for itself."""
    head = sam_header(contigs, command).rstrip("\n")
    lines = sam_lines(records).withColumn("part", F.spark_partition_id())
    heads = lines.select("part").distinct().select("part", F.lit(0).alias("o"), F.lit(head).alias("value"))
    every = heads.unionByName(lines.select("part", F.lit(1).alias("o"), "value"))
    every.repartition("part").sortWithinPartitions("part", "o").select("value").write.mode(mode).text(path)


def bedgraph_lines(rows: DataFrame) -> DataFrame:
    return rows.select(F.concat_ws("\t", "chrom", *(F.col(c).cast("string") for c in ("beg", "end", "pct", "n_meth", "n_unmeth"))).alias("value"))


def write_bedgraph(rows: DataFrame, path: str, name: str = "helixframe", mode: str = "errorifexists") -> None:
    """A folder for each context, each with one sorted file per range and the track line at the head of the first."""
    for context in ("CpG", "CHG", "CHH"):
        own = rows.where(F.col("context") == context)
        track = f'track type="bedGraph" description="{name} {context} methylation levels"'
        lines = bedgraph_lines(own.orderBy("chrom", "beg")).withColumn("o", F.lit(1))
        head = rows.sparkSession.createDataFrame([(track, 0)], "value string, o int").coalesce(1)
        head.select("value").union(lines.select("value")).write.mode(mode).text(f"{path}/{context}")


def vcf_lines(rows: DataFrame) -> DataFrame:
    """``value``: a line for each record of ``readers.vcf``'s columns."""
    dot = lambda c: F.when(c.isNull() | (c == ""), ".").otherwise(c)
    info = F.array_join(F.transform(F.array_sort(F.map_entries("info")), lambda e: F.when(e["value"] == "", e["key"]).otherwise(F.concat_ws("=", e["key"], e["value"]))), ";")
    qual = F.regexp_replace(F.col("qual").cast("string"), r"\.0$", "")
    first = F.concat_ws("\t", "chrom", (F.col("pos") + 1).cast("string"), dot(F.col("id")), "ref", dot(F.array_join("alts", ",")), dot(qual), dot(F.array_join("filters", ";")), dot(info))
    rest = F.when(F.size("samples") > 0, F.concat(F.lit("\t"), F.col("format"), F.lit("\t"), F.array_join("samples", "\t", "."))).otherwise("")
    return rows.select(F.concat(first, rest).alias("value"))


def write_vcf(rows: DataFrame, path: str, meta: list[str], samples: list[str], mode: str = "errorifexists") -> None:
    """VCF files in the order of places, the header in the first."""
    columns = "#" + "\t".join(["CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", *(["FORMAT", *samples] if samples else [])])
    head = rows.sparkSession.createDataFrame([("\n".join(["##fileformat=VCFv4.2", *meta, columns]),)], "value string").coalesce(1)
    head.union(vcf_lines(rows.orderBy("chrom", "pos"))).write.mode(mode).text(path)


def write_fastq(reads: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """FASTQ files of ``name, seq, qual``."""
    reads.select(F.concat(F.lit("@"), F.col("name"), F.lit("\n"), F.col("seq"), F.lit("\n+\n"), F.col("qual")).alias("value")).write.mode(mode).text(path)


def write_fasta(contigs: DataFrame, path: str, width: int = 60, mode: str = "errorifexists") -> None:
    """FASTA files with lines of ``width`` bases."""
    body = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")
    contigs.select(F.concat(F.lit(">"), F.col("name"), F.lit("\n"), body).alias("value")).write.mode(mode).text(path)


def write_report(lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A few lines as one file."""
    lines.coalesce(1).write.mode(mode).text(path)


def write_cuts(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Records by bucket of the coordinate: Parquet folders by ``cut_id``, sorted by site."""
    rows.repartition("cut_id").sortWithinPartitions("cut_id", "site").write.mode(mode).partitionBy("cut_id").parquet(path)


def write_index(rows: DataFrame, path: str, by: str = "kmer", mode: str = "errorifexists") -> None:
    """An access path: Parquet sorted by its key, so that row groups can be skipped."""
    rows.repartitionByRange(by).sortWithinPartitions(by).write.mode(mode).parquet(path)
