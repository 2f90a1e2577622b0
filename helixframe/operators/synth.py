"""Deterministic sequences from table keys, equal in every engine that has md5.

``dna(k)`` maps the hexadecimal digits of ``md5(k)`` to bases; contigs join 32 of them; reads are cut
from contigs at key-derived places, with key-derived conversions and substitutions, so that their true
site, strand and number of errors are known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import dna as bases

READ, CONTIG = 100, 1024
DIGITS, BASES = "0123456789abcdef", "ACGTACGTACGTACGT"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dna(key: Column) -> Column:
    return F.translate(F.md5(key.cast("string").cast("binary")), DIGITS, BASES)


def spread(rows: DataFrame, *key: str) -> DataFrame:
    """Rows dealt over all cores by a key. A small file is one task, however much is made of its rows; a number is given because adaptive execution joins small partitions again."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism), *key)


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``chrom_id, name, seq``: 1,024 bases for each part.

    Only keys are shuffled, the bases are made behind that; never broadcast, since the estimate goes by the keys' size.
    """
    part = spread(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("chrom_id")), "chrom_id")
    key = F.col("chrom_id").cast("string")
    hexadecimal = F.concat(*(F.md5(F.concat(key, F.lit(f":{i}")).cast("binary")) for i in range(CONTIG // 32)))
    return part.select("chrom_id", F.concat(F.lit("part"), key).alias("name"), F.translate(hexadecimal, DIGITS, BASES).alias("seq")).hint("merge")


def read_key() -> Column:
    """A name that no two line items share."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cents)


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``name, chrom_id, true_site, seq, n_sub``: 100 bases for each line item, on the forward strand."""
    items = table(spark, sf_dir, "lineitem").select(read_key().alias("name"), F.col("l_partkey").alias("chrom_id"), (F.col("l_orderkey") % 900).cast("int").alias("true_site"), (F.col("l_orderkey") % 3).alias("mode"), (F.col("l_linenumber") % 3).cast("int").alias("n_sub"), (F.col("l_suppkey") % 40 + 20).cast("int").alias("at"))
    cut = items.join(contigs(spark, sf_dir).select("chrom_id", F.col("seq").alias("contig")), "chrom_id").withColumn("raw", F.substring("contig", F.col("true_site") + 1, F.lit(READ)))
    turned = F.when(F.col("mode") == 1, bases.convert(F.col("raw"))).when(F.col("mode") == 2, F.concat(bases.convert(F.substring("raw", 1, 50)), F.substring("raw", 51, 50))).otherwise(F.col("raw"))

    def substituted(seq: Column, at: Column, on: Column) -> Column:
        other = F.translate(F.substring(seq, at, F.lit(1)), "ACGT", "CAAA")
        return F.when(on, F.concat(F.substring(seq, F.lit(1), at - 1), other, F.substring(seq, at + 1, F.lit(READ)))).otherwise(seq)

    first = cut.withColumn("turned", turned).withColumn("one", substituted(F.col("turned"), F.col("at"), F.col("n_sub") >= 1))
    return first.select("name", "chrom_id", "true_site", substituted(F.col("one"), F.col("at") + 17, F.col("n_sub") >= 2).alias("seq"), "n_sub")


#: The same as DuckDB's SQL, to stand after WITH.
CONTIGS_SQL = "contigs AS (SELECT p_partkey AS chrom_id, 'part' || p_partkey AS name, string_agg(translate(md5(p_partkey || ':' || i), '0123456789abcdef', 'ACGTACGTACGTACGT'), '' ORDER BY i) AS seq FROM part, range(32) t(i) GROUP BY p_partkey)"
NAME_SQL = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * 100)::BIGINT)"
READS_SQL = f"""{CONTIGS_SQL},
cut AS (SELECT {NAME_SQL} AS name, l_partkey AS chrom_id, (l_orderkey % 900)::INT AS true_site, l_orderkey % 3 AS mode, (l_linenumber % 3)::INT AS n_sub, (l_suppkey % 40 + 20)::INT AS place, substr(seq, (l_orderkey % 900 + 1)::INT, 100) AS raw FROM lineitem JOIN contigs ON l_partkey = chrom_id),
turned AS (SELECT *, CASE mode WHEN 1 THEN replace(raw, 'C', 'T') WHEN 2 THEN replace(substr(raw, 1, 50), 'C', 'T') || substr(raw, 51, 50) ELSE raw END AS t FROM cut),
once AS (SELECT *, CASE WHEN n_sub >= 1 THEN substr(t, 1, place - 1) || translate(substr(t, place, 1), 'ACGT', 'CAAA') || substr(t, place + 1) ELSE t END AS o FROM turned),
reads AS (SELECT name, chrom_id, true_site, CASE WHEN n_sub >= 2 THEN substr(o, 1, place + 16) || translate(substr(o, place + 17, 1), 'ACGT', 'CAAA') || substr(o, place + 18) ELSE o END AS seq, n_sub FROM once)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pair_id, mate, chrom_id, strand, start, end, errors``: mates 1 and 2 of each order with two items.

    Both lie on part number ``l_orderkey % count(part)``; mate 2 lies on the other strand, a key-derived
    template length away.
    """
    from pyspark.sql import Window

    n = table(spark, sf_dir, "part").select(F.count("*").alias("n_parts"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    items = table(spark, sf_dir, "lineitem").withColumn("mate", F.row_number().over(order)).where("mate <= 2").crossJoin(F.broadcast(n))  # one row
    start = F.when(F.col("mate") == 1, F.col("l_orderkey") % 400).otherwise(F.col("l_orderkey") % 400 + F.col("l_suppkey") * 7 % 650)
    return items.select(F.col("l_orderkey").alias("pair_id"), "mate", (F.col("l_orderkey") % F.col("n_parts")).alias("chrom_id"), F.when(F.col("mate") == 1, 0).otherwise(1).alias("strand"), start.cast("int").alias("start"), (start + READ).cast("int").alias("end"), (F.col("l_linenumber") % 3).cast("int").alias("errors"))


PAIRS_SQL = """mates AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS mate FROM lineitem),
pairs AS (SELECT l_orderkey AS pair_id, mate::INT AS mate, l_orderkey % (SELECT count(*) FROM part) AS chrom_id, (CASE mate WHEN 1 THEN 0 ELSE 1 END)::INT AS strand, s::INT AS "start", (s + 100)::INT AS "end", (l_linenumber % 3)::INT AS errors
          FROM (SELECT *, CASE mate WHEN 1 THEN l_orderkey % 400 ELSE l_orderkey % 400 + l_suppkey * 7 % 650 END AS s FROM mates WHERE mate <= 2))"""


def since_epoch(column: str, unit: str = "SECOND") -> Column:
    """Whole units since 1970 of a timestamp without time zone, whatever the session's zone."""
    return F.expr(f"timestampdiff({unit}, timestamp_ntz'1970-01-01 00:00:00', cast({column} as timestamp_ntz))")


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``chrom, beg, end, payload``: events as intervals, the user as chromosome, seconds as coordinates."""
    second = since_epoch("ts")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("chrom"), second.alias("beg"), (second + 3600 * (1 + F.col("event_id") % 48)).alias("end"), F.col("event_id").alias("payload"), "event_type")


VISITS_SQL = "visits AS (SELECT user_id AS chrom, floor(epoch(ts))::BIGINT AS beg, floor(epoch(ts))::BIGINT + 3600 * (1 + event_id % 48) AS \"end\", event_id AS payload, event_type FROM events)"


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``source, chrom, pos, ref, alts, qual, filters, gts``: variants of the parts, one source for each order priority."""
    orders = table(spark, sf_dir, "orders")
    d = dna(F.col("o_orderkey"))
    ref = F.substring(d, F.lit(1), (1 + F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderkey") % 3).otherwise(0)).cast("int"))
    alt = F.substring(d, F.lit(5), (1 + F.when(F.col("o_orderkey") % 7 == 0, F.col("o_orderkey") % 4).otherwise(0)).cast("int"))
    more = F.when(F.col("o_orderkey") % 11 == 0, F.array(alt, F.concat(ref, F.lit("A")))).otherwise(F.array(alt))
    gts = F.array((F.col("o_orderkey") % 3 - 1).cast("int"), (F.col("o_custkey") % 3 - 1).cast("int"))
    return orders.select(F.substring("o_orderpriority", 1, 1).cast("int").alias("source"), (F.col("o_orderkey") % 50).alias("chrom"), (F.col("o_custkey") % 100).alias("pos"), ref.alias("ref"), more.alias("alts"), (F.col("o_orderkey") % 60).cast("int").alias("qual"), F.when(F.col("o_orderkey") % 60 < 10, F.array(F.lit("q10"))).otherwise(F.array(F.lit("PASS"))).alias("filters"), gts.alias("gts"), F.col("o_orderkey").alias("id"))


VARIANTS_SQL = """keyed AS (SELECT *, translate(md5(o_orderkey::VARCHAR), '0123456789abcdef', 'ACGTACGTACGTACGT') AS d FROM orders),
cutv AS (SELECT *, substr(d, 1, (1 + CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 3 ELSE 0 END)::INT) AS ref, substr(d, 5, (1 + CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey % 4 ELSE 0 END)::INT) AS alt FROM keyed),
variants AS (SELECT substr(o_orderpriority, 1, 1)::INT AS source, o_orderkey % 50 AS chrom, o_custkey % 100 AS pos, ref, CASE WHEN o_orderkey % 11 = 0 THEN [alt, ref || 'A'] ELSE [alt] END AS alts, (o_orderkey % 60)::INT AS qual, CASE WHEN o_orderkey % 60 < 10 THEN ['q10'] ELSE ['PASS'] END AS filters, [(o_orderkey % 3 - 1)::INT, (o_custkey % 3 - 1)::INT] AS gts, o_orderkey AS id FROM cutv)"""
