"""Queries over variants made from orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.functions import stats, variant
from helixframe.operators import synth, variants

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = "WITH " + sql
        return f

    return add


_TYPE = """CASE WHEN {a} = {r} THEN 0 WHEN length({a}) = length({r}) THEN CASE WHEN len([1 for i in range(1, length({r}) + 1) if {a}[i] <> {r}[i]]) = 1 THEN 1 ELSE 2 END
 WHEN list_max([i for i in range(0, least(length({a}), length({r})) + 1) if substr({a}, 1, i::INT) = substr({r}, 1, i::INT)]) + list_max([i for i in range(0, least(length({a}), length({r})) + 1) if right({a}, i) = right({r}, i)]) >= least(length({a}), length({r})) THEN 4 ELSE 8 END"""


@query(f"{synth.VARIANTS_SQL} SELECT id, a.alt, ({_TYPE.format(a='a.alt', r='ref')})::INT AS type, (CASE WHEN a.alt = ref THEN 0 WHEN length(a.alt) = length(ref) THEN len([1 for i in range(1, length(ref) + 1) if a.alt[i] <> ref[i]]) ELSE length(a.alt) - length(ref) END)::INT AS n FROM variants, LATERAL (SELECT unnest(alts) AS alt) a")
def variant_type(spark, sf_dir):
    """Type and length of each alternative."""
    rows = synth.variants(spark, sf_dir).select("id", "ref", F.explode("alts").alias("alt"))
    return rows.select("id", "alt", variant.variant_type(F.col("ref"), F.col("alt")).alias("t")).select("id", "alt", "t.type", "t.n")


@query(f"{synth.VARIANTS_SQL} SELECT id, (CASE WHEN gts[1] < 0 OR gts[2] < 0 THEN 6 WHEN gts[1] = gts[2] THEN CASE gts[1] WHEN 0 THEN 0 ELSE 1 END WHEN gts[1] = 0 OR gts[2] = 0 THEN 2 ELSE 3 END)::INT AS kind, (CASE WHEN gts[1] >= 0 AND gts[2] >= 0 THEN greatest(gts[1], gts[2]) * (greatest(gts[1], gts[2]) + 1) // 2 + least(gts[1], gts[2]) END)::INT AS place FROM variants")
def genotype_type(spark, sf_dir):
    """Genotype types and their place among all genotypes."""
    a, b = F.get("gts", F.lit(0)), F.get("gts", F.lit(1))
    return synth.variants(spark, sf_dir).select("id", variant.genotype_type(F.col("gts")).alias("kind"), F.when((a >= 0) & (b >= 0), variant.diploid_index(a, b)).alias("place"))


@query(f"{synth.VARIANTS_SQL}, c AS (SELECT chrom, pos, ref, alts[1] AS alt, unnest(gts) AS g FROM variants) SELECT chrom, pos, ref, alt, count(*) FILTER (g >= 0) AS an, count(*) FILTER (g = 1) AS ac FROM c GROUP BY ALL")
def allele_counts(spark, sf_dir):
    """Called alleles and first alternatives by site over all records."""
    rows = variants.allele_counts(synth.variants(spark, sf_dir).withColumn("alt", F.get("alts", F.lit(0))).withColumn("n_alts", F.size("alts")), ["chrom", "pos", "ref", "alt"])
    return rows.groupBy("chrom", "pos", "ref", "alt").agg(F.sum("an").alias("an"), F.sum(F.get("ac", F.lit(0))).alias("ac"))


@query(f"{synth.VARIANTS_SQL}, l AS (SELECT chrom, pos, source, ref || ',' || array_to_string(list_sort(alts), ',') AS pair, min({{'a': ref, 'b': array_to_string(list_sort(alts), ',')}}) AS m FROM variants GROUP BY ALL) SELECT chrom, pos, pair, " + ", ".join(f"max(CASE WHEN source = {i} THEN m.a || '>' || m.b END) AS s{i}" for i in range(1, 6)) + " FROM l GROUP BY chrom, pos, pair")
def synced_outer_join(spark, sf_dir):
    """Five sources merged on place and alleles."""
    rows = variants.synced(synth.variants(spark, sf_dir), 5, "exact")
    return rows.select("chrom", "pos", "pair", *(F.get("sources", F.lit(i)).alias(f"s{i + 1}") for i in range(5)))


@query(f"{synth.VARIANTS_SQL}, t AS (SELECT *, ({_TYPE.format(a='x', r='ref')}) AS k FROM (SELECT *, unnest(alts) AS x FROM variants)), b AS (SELECT id, bit_or(k::INT) AS types FROM t GROUP BY id), p AS (SELECT v.*, CASE WHEN types & 3 <> 0 THEN 'snp' ELSE ref || ',' || array_to_string(list_sort(alts), ',') END AS pair FROM variants v JOIN b USING (id)) SELECT chrom, pos, pair, count(DISTINCT source)::BIGINT AS n_sources FROM p GROUP BY chrom, pos, pair")
def synced_by_type(spark, sf_dir):
    """Sources that have a record of a place, single-base changes paired whatever their alleles."""
    rows = variants.synced(synth.variants(spark, sf_dir), 5, "snps")
    return rows.select("chrom", "pos", "pair", F.size(F.filter("sources", lambda s: s.isNotNull())).cast("bigint").alias("n_sources"))


@query(None)
def synced_some(spark, sf_dir):
    """Sources merged where records share any allele."""
    return variants.synced(synth.variants(spark, sf_dir), 5, "some")


@query(f"{synth.VARIANTS_SQL} SELECT id, list_contains(filters, 'q10') AS low, CASE WHEN list_contains(filters, 'PASS') THEN ['deep'] ELSE ['q10', 'deep'] END AS added, list_contains(filters, 'PASS') AS passed FROM variants")
def filter_update(spark, sf_dir):
    """Filters asked for and set."""
    f = F.col("filters")
    return synth.variants(spark, sf_dir).select("id", variant.has_filter(f, "q10").alias("low"), variant.add_filter(f, "deep").alias("added"), variant.has_filter(f, "PASS").alias("passed"))


@query(f"{synth.VARIANTS_SQL} SELECT id, [a for a, i in alts if list_contains(gts, i)] AS alts, gts FROM variants")
def trim_alleles(spark, sf_dir):
    """Alternatives that genotypes show (genotypes name the first at most)."""
    return variants.trimmed(synth.variants(spark, sf_dir)).select("id", "alts", "gts")


@query("i AS (SELECT o_orderkey AS id, o_orderkey % 200 AS dp, (o_orderkey % 50) / 100.0::DOUBLE AS af FROM orders) SELECT id, dp::DOUBLE AS dp, af, true AS db, 3.0::DOUBLE AS second FROM i")
def info_fields(spark, sf_dir):
    """INFO columns parsed, read by type and extended."""
    k = F.col("o_orderkey")
    raw = F.concat(F.lit("DP="), (k % 200).cast("string"), F.lit(";AF="), (k % 50 / 100).cast("string"), F.lit(";DB"))
    rows = synth.table(spark, sf_dir, "orders").select(k.alias("id"), variant.set_info(variant.info(raw), "XS", F.lit("1,3")).alias("i"))
    number = lambda n, at: F.get(variant.info_numbers(F.try_element_at("i", F.lit(n))), F.lit(at))
    return rows.select("id", number("DP", 0).alias("dp"), number("AF", 0).alias("af"), F.map_contains_key("i", "DB").alias("db"), number("XS", 1).alias("second"))


@query(None)
def fisher_test(spark, sf_dir):
    """Fisher's exact test of return flag against shipping speed, by supplier."""
    late = F.dayofmonth("l_shipdate") > 15
    n = lambda c: F.count(F.when(c, 1))
    back = F.col("l_returnflag") == "R"
    tables = synth.table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(n(back & late).alias("a"), n(back & ~late).alias("b"), n(~back & late).alias("c"), n(~back & ~late).alias("d"))
    return tables.withColumn("p", stats.fisher_exact("a", "b", "c", "d")).select("l_suppkey", "a", "b", "c", "d", "p.left", "p.right", "p.two")
