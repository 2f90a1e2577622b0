"""Queries over alignment records made from line items: CIGARs, flags, fields, pileups."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.functions import cigar, dna, text
from helixframe.operators import pileup, synth

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Shapes of records: 20 read bases each.
CIGARS = ("20M", "5S15M", "8M2I10M", "10M3D10M", "6M100N14M", "3H20M", "4M1I5M2D10M", "10=1X9=")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def alignments(spark, sf_dir):
    """``qname, flag, rname, pos, cigar, tlen, seq, qual`` for each order: 20 bases, a key-derived flag, shape and place."""
    k = F.col("o_orderkey")
    shape = F.element_at(F.array(*map(F.lit, CIGARS)), (k % len(CIGARS) + 1).cast("int"))
    flag = (k * 37 % 4096).cast("int")
    return synth.table(spark, sf_dir, "orders").select(k.cast("string").alias("qname"), flag.alias("flag"), F.concat(F.lit("chr"), (k % 5).cast("string")).alias("rname"), (F.col("o_custkey") % 300).cast("int").alias("pos"), shape.alias("cigar"), (k % 60).cast("int").alias("tlen"), F.substring(synth.dna(k), 1, 20).alias("seq"), F.repeat(F.lit("I"), F.lit(20)).alias("qual"))


_SHAPES = "[" + ", ".join(f"'{c}'" for c in CIGARS) + "]"
_RECORDS = f"WITH r AS (SELECT o_orderkey AS k, o_orderkey::VARCHAR AS qname, (o_orderkey * 37 % 4096)::INT AS flag, 'chr' || (o_orderkey % 5) AS rname, (o_custkey % 300)::INT AS pos, {_SHAPES}[(o_orderkey % {len(CIGARS)} + 1)::INT] AS cigar, substr(translate(md5(o_orderkey::VARCHAR), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, 20) AS seq FROM orders), o AS (SELECT *, list_transform(regexp_extract_all(cigar, '[0-9]+[A-Z=]'), lambda x: {{'n': regexp_extract(x, '[0-9]+')::INT, 'op': x[-1]}}) AS ops FROM r)"


@query(f"{_RECORDS}, n AS (SELECT *, list_sum([x.n for x in ops if contains('MIS=X', x.op)])::INT AS q, list_sum([x.n for x in ops if contains('MDN=X', x.op)])::INT AS rl FROM o) SELECT qname, q AS query_length, rl AS reference_length, pos + CASE WHEN flag & 4 <> 0 THEN 1 ELSE rl END AS \"end\" FROM n")
def cigar_lengths(spark, sf_dir):
    """Lengths on query and reference, and ends."""
    c = F.col("cigar")
    return alignments(spark, sf_dir).select("qname", cigar.query_length(c).alias("query_length"), cigar.reference_length(c).alias("reference_length"), cigar.end_position(F.col("flag"), F.col("pos"), c).alias("end"))


_NAMES = "[" + ", ".join(f"'{n}'" for n in cigar.FLAGS) + "]"


@query(f"{_RECORDS} SELECT qname, flag, array_to_string([{_NAMES}[i + 1] for i in range(0, 12) if flag & (1 << i) <> 0], ',') AS names, flag AS again, (flag & 1796) = 0 AS usable FROM o")
def flag_decode(spark, sf_dir):
    """Flags as names and back."""
    rows = alignments(spark, sf_dir).select("qname", "flag", cigar.flag_names(F.col("flag")).alias("names"), cigar.usable(F.col("flag")).alias("usable"))
    return rows.withColumn("again", F.when(F.col("names") == "", 0).otherwise(cigar.flag_value(F.col("names"))))


@query("SELECT o_orderkey AS id, (o_orderkey % 1000)::BIGINT AS nm, (o_orderkey % 97) / 4.0::DOUBLE AS score, substr(o_orderpriority, 1, 1) AS kind, o_orderstatus AS status, (o_orderkey % 10 + 2 * (o_orderkey % 10))::DOUBLE AS total, NULL::BIGINT AS wrong, 'NM:i:7\tXA:A:' || substr(o_orderpriority, 1, 1) || '\tXB:B:i,' || o_orderkey % 10 || ',' || 2 * (o_orderkey % 10) || '\tXZ:Z:' || o_orderstatus AS rest FROM orders")
def aux_tag_cast(spark, sf_dir):
    """Optional fields read by type, one removed and one set."""
    k = F.col("o_orderkey")
    ten = (k % 10).cast("string")
    fields = F.array(F.concat(F.lit("NM:i:"), (k % 1000).cast("string")), F.concat(F.lit("XF:f:"), ((k % 97) / 4).cast("string")), F.concat(F.lit("XA:A:"), F.substring("o_orderpriority", 1, 1)), F.concat(F.lit("XZ:Z:"), F.col("o_orderstatus")), F.concat(F.lit("XB:B:i,"), ten, F.lit(","), (2 * (k % 10)).cast("string")))
    rows = synth.table(spark, sf_dir, "orders").select(k.alias("id"), cigar.tags(fields).alias("t"))
    t = F.col("t")
    numbers = F.aggregate(cigar.tag_array(cigar.tag(t, "XB")), F.lit(0.0), lambda s, x: s + x)
    rest = cigar.tag_text(cigar.with_tag(cigar.without_tag(t, "XF"), "NM", "i", F.lit(7)))
    return rows.select("id", cigar.tag_int(cigar.tag(t, "NM")).alias("nm"), cigar.tag_float(cigar.tag(t, "XF")).alias("score"), cigar.tag_char(cigar.tag(t, "XA")).alias("kind"), cigar.tag_string(cigar.tag(t, "XZ")).alias("status"), numbers.alias("total"), cigar.tag_int(cigar.tag(t, "XZ")).alias("wrong"), rest.alias("rest"))


# each base of the query and the reference, by running sums over the operations
_COLUMNS = f"""{_RECORDS}, u AS (SELECT * FROM o WHERE flag & 1796 = 0),
e AS (SELECT qname, rname, pos, seq, i, ops[i].n AS n, ops[i].op AS op, coalesce(list_sum([x.n for x in ops[1:i - 1] if contains('MIS=X', x.op)]), 0)::INT AS q0, coalesce(list_sum([x.n for x in ops[1:i - 1] if contains('MDN=X', x.op)]), 0)::INT AS r0 FROM u, LATERAL (SELECT unnest(range(1, len(ops) + 1)) AS i)),
c AS (SELECT qname, rname, (pos + r0 + j)::INT AS pos, (q0 + CASE WHEN op IN ('D', 'N') THEN 0 ELSE j END)::INT AS qpos, op, CASE WHEN op IN ('D', 'N') THEN NULL ELSE substr(seq, (q0 + j + 1)::INT, 1) END AS base FROM e, LATERAL (SELECT unnest(range(0, n)) AS j) WHERE contains('MDN=X', op))"""


@query(f"{_COLUMNS} SELECT rname, pos, count(*) AS depth, count(*) FILTER (base = 'A') AS n_a, count(*) FILTER (base = 'C') AS n_c, count(*) FILTER (base = 'G') AS n_g, count(*) FILTER (base = 'T') AS n_t, count(*) FILTER (op = 'D') AS n_del FROM c WHERE op <> 'N' GROUP BY rname, pos")
def pileup_columns(spark, sf_dir):
    """Depth and bases by place over usable records."""
    return pileup.depth(pileup.columns(alignments(spark, sf_dir), None))


@query(None)
def pileup_text(spark, sf_dir):
    """The pileup's lines."""
    return pileup.text(pileup.columns(alignments(spark, sf_dir), None))


@query(f"{_RECORDS}, e AS (SELECT qname, seq, i, ops[i].n AS n, ops[i].op AS op, coalesce(list_sum([x.n for x in ops[1:i - 1] if contains('MIS=X', x.op)]), 0)::INT AS q0 FROM o, LATERAL (SELECT unnest(range(1, len(ops) + 1)) AS i)) SELECT qname, coalesce(string_agg(CASE WHEN op IN ('M', '=', 'X') THEN substr(seq, q0 + 1, n) WHEN op IN ('D', 'N') THEN repeat('N', n) ELSE '' END, '' ORDER BY i), '') AS shown FROM e GROUP BY qname")
def cigar_project(spark, sf_dir):
    """Reads on the reference axis."""
    return alignments(spark, sf_dir).select("qname", cigar.projected(F.col("seq"), F.col("cigar")).alias("shown"))


@query("WITH r AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, (l_quantity::INT + 10) AS q1, (l_suppkey % 40 + 10)::INT AS q2, l_linenumber % 2 = 0 AS same FROM lineitem) SELECT k, n, p, s, sum(CASE WHEN same THEN least(q1 + q2, 200) WHEN q1 >= q2 THEN trunc(q1 * 0.8::DOUBLE)::INT ELSE 0 END)::BIGINT AS first, sum(CASE WHEN same THEN 0 WHEN q1 >= q2 THEN 0 ELSE trunc(q2 * 0.8::DOUBLE)::INT END)::BIGINT AS second FROM r GROUP BY k, n, p, s")
def mate_overlap_quality(spark, sf_dir):
    """Qualities of overlapping mates merged by place, summed by line item."""
    items = synth.table(spark, sf_dir, "lineitem")
    same = F.col("l_linenumber") % 2 == 0
    base2 = F.when(same, "A").otherwise("C")
    two = F.array(F.struct(F.lit(64).alias("flag"), F.lit("A").alias("base"), (F.col("l_quantity").cast("int") + 10).alias("qual")), F.struct(F.lit(128).alias("flag"), base2.alias("base"), (F.col("l_suppkey") % 40 + 10).cast("int").alias("qual")))
    rows = items.select(synth.read_key().alias("qname"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.lit("chr").alias("rname"), F.lit(0).alias("pos"), F.lit(False).alias("is_del"), F.explode(two).alias("m")).select("*", "m.*")
    out = pileup.merged_overlaps(rows)
    return out.groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s")).agg(F.sum(F.when(F.col("flag") == 64, F.col("qual"))).alias("first"), F.sum(F.when(F.col("flag") == 128, F.col("qual"))).alias("second"))


@query("SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 1500 WHEN 1 THEN 2000000 WHEN 2 THEN 1234 ELSE NULL END::BIGINT AS n, 'a b' AS plain, (instr(o_orderpriority, '-') - 1)::INT AS dash, bit_count(o_orderkey)::INT AS ones, trunc((o_orderkey % 100)::DOUBLE / 100 * 100)::INT AS pct, list_reduce(list_prepend(0::BIGINT, [instr('ACGT', substr(translate(md5(o_orderkey::VARCHAR), '0123456789abcdef', 'ACGTACGTACGTACGT'), j::INT, 1)) - 1 for j in range(1, 13)]), lambda a, d: a * 4 + d)::BIGINT AS packed, substr(translate(md5(o_orderkey::VARCHAR), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, 12) AS again FROM orders")
def scalar_functions(spark, sf_dir):
    """Numbers with units, escapes, places, bits, percents, packed bases."""
    k = F.col("o_orderkey")
    number = F.element_at(F.array(F.lit("1.5k"), F.lit("2M"), F.lit("1,234"), F.lit("x")), (k % 4 + 1).cast("int"))
    bases = F.substring(synth.dna(k), 1, 12)
    rows = synth.table(spark, sf_dir, "orders").select(k.alias("id"), text.decimal(number).alias("n"), text.percent_decoded(F.lit("a%20b")).alias("plain"), text.found_at(F.col("o_orderpriority"), F.lit("-")).cast("int").alias("dash"), text.ones(k).cast("int").alias("ones"), dna.percent(k % 100, F.lit(100)).alias("pct"), text.packed(bases).alias("packed"))
    return rows.withColumn("again", text.unpacked(F.col("packed"), 12))
