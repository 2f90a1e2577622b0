"""Benchmark passages found in documents by seeding and extending."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import dna
from helixframe.operators import rank, synth

K, STEP, VOTES = 16, 4, 4


def seed_and_extend_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best places of each passage: seeds of 16 characters, at least 4 votes on a diagonal, verified by counting differing characters.

    The documents' k-mers are joined where they lie if the passages' seeds are small; Spark decides by
    their size.
    """
    docs = synth.table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.col("text").alias("doc"))
    items = synth.table(spark, sf_dir, "benchmark").where("text is not null").select("item_id", F.col("text").alias("item"))
    own = items.select("item_id", F.posexplode(dna.grams(F.col("item"), K)).alias("offset", "kmer")).where(F.col("offset") % STEP == 0)
    there = docs.select("doc_id", F.posexplode(dna.grams(F.col("doc"), K)).alias("site", "kmer"))
    voted = there.join(own, "kmer").groupBy("item_id", "doc_id", (F.col("site") - F.col("offset")).cast("int").alias("diagonal")).agg(F.count("*").alias("votes")).where(F.col("votes") >= VOTES)
    both = voted.where("diagonal >= 0").join(items, "item_id").join(docs, "doc_id")
    part = F.substring("doc", F.col("diagonal") + 1, F.length("item"))
    verified = both.withColumn("part", part).where(F.length("part") == F.length("item")).withColumn("err", dna.mismatches(F.col("part"), F.col("item")))
    best = rank.best_hits(verified.select("item_id", "doc_id", "diagonal", "votes", "err", F.length("item").alias("n")), ["item_id"], [F.asc("err")], ["doc_id", "diagonal"])
    return best.where(F.col("err") <= 0.08 * F.col("n")).select("item_id", "doc_id", "diagonal", "votes", "err", "n_best")


QUERIES = {"seed_and_extend_passages": seed_and_extend_passages}
ORACLES = {
    "seed_and_extend_passages": f"""
    WITH own AS (SELECT item_id, o AS "offset", substr(text, (o + 1)::INT, {K}) AS kmer FROM benchmark, LATERAL (SELECT unnest(range(0, length(text) - {K - 1}, {STEP})) AS o)),
    parts AS (SELECT doc_id, length(text) AS len, unnest(range(0, length(text), 500)) AS first, unnest([substr(text, (f + 1)::INT, {500 + K - 1}) for f in range(0, length(text), 500)]) AS part FROM documents WHERE text IS NOT NULL),
    there AS (SELECT doc_id, first + i AS site, substr(part, (i + 1)::INT, {K}) AS kmer FROM parts, LATERAL (SELECT unnest(range(0, least(500, len - first - {K - 1}))) AS i)),
    voted AS (SELECT item_id, doc_id, (site - "offset")::INT AS diagonal, count(*) AS votes FROM there JOIN own USING (kmer) GROUP BY ALL HAVING count(*) >= {VOTES}),
    two AS (SELECT v.*, b.text AS item, substr(d.text, diagonal + 1, length(b.text)::INT) AS part FROM voted v JOIN benchmark b USING (item_id) JOIN documents d USING (doc_id) WHERE diagonal >= 0),
    judged AS (SELECT item_id, doc_id, diagonal, votes, length(item) AS n, len([1 for i in range(1, length(item) + 1) if item[i] <> part[i]])::INT AS err FROM two WHERE length(part) = length(item)),
    best AS (SELECT *, rank() OVER (PARTITION BY item_id ORDER BY err) AS r FROM judged)
    SELECT item_id, doc_id, diagonal, votes, err, count(*) OVER (PARTITION BY item_id) AS n_best FROM best WHERE r = 1 AND err <= 0.08 * n
    """
}
