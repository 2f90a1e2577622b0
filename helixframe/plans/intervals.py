"""Queries over events as intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.operators import intervals, synth

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
DAY = 86_400


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = "WITH " + sql
        return f

    return add


def _by_type(spark, sf_dir, kind: str):
    return synth.visits(spark, sf_dir).where(F.col("event_type") == kind).select("chrom", "beg", "end", "payload")


_KINDS = f"{synth.VISITS_SQL}, k AS (SELECT min(event_type) AS one, max(event_type) AS two FROM events), a AS (SELECT * FROM visits, k WHERE event_type = one), b AS (SELECT * FROM visits, k WHERE event_type = two)"


def _two(spark, sf_dir):
    kinds = synth.table(spark, sf_dir, "events").agg(F.min("event_type").alias("one"), F.max("event_type").alias("two")).first()
    return _by_type(spark, sf_dir, kinds["one"]), _by_type(spark, sf_dir, kinds["two"])


@query(f'{_KINDS} SELECT a.chrom, a.payload AS l_payload, b.payload AS r_payload, (least(a."end", b."end") - greatest(a.beg, b.beg))::BIGINT AS shared FROM a JOIN b ON a.chrom = b.chrom AND a.beg < b."end" AND a."end" > b.beg')
def interval_overlap_join(spark, sf_dir):
    """Overlapping visits of two event types of a user."""
    a, b = _two(spark, sf_dir)
    both = intervals.overlap_join(a, b, DAY)
    return both.select(F.col("l_chrom").alias("chrom"), "l_payload", "r_payload", (F.least("l_end", "r_end") - F.greatest("l_beg", "r_beg")).alias("shared"))


@query(f'{_KINDS} SELECT chrom, beg, "end", payload FROM a WHERE EXISTS (SELECT 1 FROM b WHERE a.chrom = b.chrom AND a.beg < b."end" AND a."end" > b.beg)')
def interval_semi(spark, sf_dir):
    """Visits that overlap one of the other type."""
    return intervals.overlap_semi(*_two(spark, sf_dir), DAY)


@query(f'{_KINDS} SELECT chrom, beg, "end", payload FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.chrom = b.chrom AND a.beg < b."end" AND a."end" > b.beg)')
def interval_anti(spark, sf_dir):
    """Visits that overlap none of the other type."""
    return intervals.overlap_semi(*_two(spark, sf_dir), DAY, anti=True)


@query(f'{synth.VISITS_SQL}, s AS (SELECT *, CASE WHEN beg <= max("end") OVER (PARTITION BY chrom ORDER BY beg, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM visits), i AS (SELECT *, sum(n) OVER (PARTITION BY chrom ORDER BY beg, "end" ROWS UNBOUNDED PRECEDING) AS island FROM s) SELECT chrom, min(beg) AS beg, max("end") AS "end" FROM i GROUP BY chrom, island')
def interval_merge(spark, sf_dir):
    """The union of each user's visits."""
    return intervals.merged(synth.visits(spark, sf_dir))


@query(f'{synth.VISITS_SQL}, s AS (SELECT chrom, place, sum(d) AS d FROM (SELECT chrom, beg AS place, 1 AS d FROM visits UNION ALL SELECT chrom, "end", -1 FROM visits) GROUP BY chrom, place HAVING sum(d) <> 0), r AS (SELECT chrom, place AS beg, lead(place) OVER (PARTITION BY chrom ORDER BY place) AS "end", (sum(d) OVER (PARTITION BY chrom ORDER BY place))::BIGINT AS depth FROM s) SELECT * FROM r WHERE depth > 0')
def coverage_depth(spark, sf_dir):
    """Segments of equal depth of each user's visits."""
    return intervals.coverage(synth.visits(spark, sf_dir))


@query(f'{synth.VISITS_SQL} SELECT a.payload, b.payload AS next, b.beg - a.beg AS gap FROM visits a JOIN visits b ON a.chrom = b.chrom AND b.beg - a.beg BETWEEN 1 AND 7200')
def time_band_join(spark, sf_dir):
    """Visits of a user that begin within two hours after another."""
    rows = synth.visits(spark, sf_dir)
    near = intervals.band_join(rows.select("chrom", "beg", "payload"), rows.select("chrom", F.col("beg").alias("later"), F.col("payload").alias("next")), ["chrom"], ("beg", "later"), 1, 7200)
    return near.select("payload", "next", (F.col("later") - F.col("beg")).alias("gap"))


@query("r AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'chr' || user_id || ':' || (event_id + 1) || '-' || (event_id + 100) WHEN 1 THEN 'chr' || user_id || ':1,000-' || (event_id + 2000) WHEN 2 THEN 'chr' || user_id || ':' || (event_id + 5) ELSE 'chr' || user_id END AS t, user_id FROM events) SELECT event_id, 'chr' || user_id AS chrom, (CASE event_id % 4 WHEN 0 THEN event_id WHEN 1 THEN 999 WHEN 2 THEN event_id + 4 ELSE 0 END)::BIGINT AS beg, (CASE event_id % 4 WHEN 0 THEN event_id + 100 WHEN 1 THEN event_id + 2000 ELSE 2147483647 END)::BIGINT AS \"end\" FROM r")
def region_parse(spark, sf_dir):
    """Region strings as half-open intervals."""
    e, u = F.col("event_id"), F.col("user_id").cast("string")
    name = F.concat(F.lit("chr"), u)
    text = F.when(e % 4 == 0, F.concat(name, F.lit(":"), (e + 1).cast("string"), F.lit("-"), (e + 100).cast("string"))).when(e % 4 == 1, F.concat(name, F.lit(":1,000-"), (e + 2000).cast("string"))).when(e % 4 == 2, F.concat(name, F.lit(":"), (e + 5).cast("string"))).otherwise(name)
    return synth.table(spark, sf_dir, "events").select("event_id", intervals.region(text).alias("r")).select("event_id", "r.chrom", "r.beg", "r.end")


@query(f'{synth.VISITS_SQL} SELECT chrom, count(*) AS n_regions, min(beg) AS first, max("end") AS last FROM visits GROUP BY chrom')
def region_counts(spark, sf_dir):
    """Regions and extent of each chromosome."""
    return synth.visits(spark, sf_dir).groupBy("chrom").agg(F.count("*").alias("n_regions"), F.min("beg").alias("first"), F.max("end").alias("last"))
