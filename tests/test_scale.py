"""Steps that must grow no faster than their input: how work is dealt out, and that shortened steps give what the plain ones give."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from helixframe.operators import context, synth
from helixframe.plans import catalogue

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def sequences(seed, sizes=(3000, 1, 2, 3, 0, 1025), letters="ACGTN"):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(letters) for _ in range(n)) for n in sizes]


# Contigs were made, and all that followed from them, in the one task that reads a small file of keys.
SPREAD = ["context_counts", "kmer_count", "kmer_spectrum_topk", "context_by_window", "edit_distance_filter", "bs_convert_forward", "extraction_counters", "methyl_dedup", "region_bases", "revcomp", "context_classify"]


@pytest.mark.parametrize("name", SPREAD)
def test_contigs_are_made_by_all_cores(spark, name):
    keys = synth.contigs(spark, SF).select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(keys) > 1
    shown = plan(catalogue.QUERIES[name](spark, SF))
    assert "REPARTITION_BY_NUM" in shown and "BroadcastHashJoin" not in shown


def test_contexts_are_counted_before_they_are_rows(spark):
    seqs = sequences(41)
    contigs = spark.createDataFrame(list(enumerate(seqs)), "chrom_id int, seq string")
    want = Counter()
    for r in context.positions(contigs).collect():
        want[r.chrom_id, r.context, r.base] += r.pos + 10**6
    for size in (7, 1024):
        got = context.tallies(contigs, size).groupBy("chrom_id", "context", "base").agg(F.sum("n").alias("n"), F.sum("places").alias("places")).collect()
        assert {(r.chrom_id, r.context, r.base): r.n * 10**6 + r.places for r in got} == want
    assert context.tallies(contigs).count() <= 9 * len(seqs)


@pytest.mark.parametrize("k", [1, 6, 8, 12, 31, 33])
def test_kmers_are_counted_within_tasks(spark, k):
    from helixframe.operators import seed

    seqs = sequences(k, letters="ACGTACGTACGTACGTACGTACGTN") + ["ACGT" * 50] * 3
    contigs = spark.createDataFrame(list(enumerate(seqs)), "chrom_id int, seq string").repartition(3)
    want = Counter(s[i : i + k] for s in seqs for i in range(len(s) - k + 1) if "N" not in s[i : i + k])
    assert {r.kmer: r.n for r in seed.counts(contigs, k, 64).collect()} == want
    if k <= 10:
        assert "Generate explode(filter" not in plan(seed.counts(contigs, k, 64))


def test_contexts_by_window_over_runs_of_any_length(spark):
    rnd = random.Random(43)
    seqs = sequences(43)
    runs = []
    for c, s in enumerate(seqs):
        i = 0
        while i < len(s):
            n = rnd.choice((1, 1, 2, 3, 50))
            runs.append((c, i, s[i : i + n]))
            i += n
    contigs = spark.createDataFrame(list(enumerate(seqs)), "chrom_id int, seq string")
    want = Counter(tuple(r) for r in context.positions(contigs).collect())
    assert Counter(tuple(r) for r in context.positions_by_window(spark.createDataFrame(runs, "chrom_id int, pos int, base string")).collect()) == want


def test_cigars_of_a_batch_equal_those_of_single_rows():
    from helixframe.operators import verify

    rnd = random.Random(44)
    e, reads, windows = 4, [], []
    for _ in range(300):
        w = "".join(rnd.choice("ACGT") for _ in range(38))
        r = list(w[4:34])
        for _ in range(rnd.randrange(0, 4)):
            i = rnd.randrange(len(r))
            r[i : i + 1] = rnd.choice([["A"], [], ["C", "G"]])
        reads.append(("".join(r) + w[34:])[:30].ljust(30, "A"))
        windows.append(w)
    _, ends, table = verify.distances(reads, windows, e)
    want = []
    for k, (r, w) in enumerate(zip(reads, windows)):
        i, d, ops, m = 30, int(ends[k]) - 30, "", table[:, k]
        while i:
            cost = not (r[i - 1] == w[i + d - 1] or (r[i - 1] == "T" and w[i + d - 1] == "C"))
            if m[i, d] == m[i - 1, d] + cost:
                i, ops = i - 1, "M" + ops
            elif d and m[i, d] == m[i, d - 1] + 1:
                d, ops = d - 1, "D" + ops
            else:
                i, d, ops = i - 1, d + 1, "I" + ops
        want.append((d, verify.run_lengths(list(ops))))
    assert verify.cigars(reads, windows, ends, table) == want and any("D" in c and "I" in c for _, c in want)


def test_distances_of_batches_equal_those_of_single_rows(spark):
    from helixframe.functions import dna

    rnd = random.Random(45)
    rows = [("", ""), ("", "A"), ("A", None), (None, "A"), ("ACGT", "ACGT")]
    for _ in range(300):
        a = [rnd.choice("ACGT") for _ in range(rnd.randrange(0, 12))]
        b = list(a)
        for _ in range(rnd.randrange(0, 4)):
            i = rnd.randrange(len(b) + 1)
            b[i : i + rnd.randrange(2)] = rnd.choice([[], ["A"], ["C"]])
        rows.append(("".join(a), "".join(b)))
    df = spark.createDataFrame(rows, "a string, b string")
    for most in (0, 1, 3):
        assert df.where(~F.levenshtein("a", "b", most).eqNullSafe(dna.edit_distance(F.col("a"), F.col("b"), most))).count() == 0
    got = df.select("a", "b", dna.mismatches(F.col("a"), F.col("b")).alias("n"), dna.bisulfite_mismatches(F.col("a"), F.col("b")).alias("m")).collect()
    for r in got:
        if r.a is None or r.b is None:
            assert r.n is None and r.m is None
        elif len(r.a) == len(r.b):
            assert (r.n, r.m) == (sum(x != y for x, y in zip(r.a, r.b)), sum(x != y and (x, y) != ("T", "C") for x, y in zip(r.a, r.b)))


def test_hits_are_shuffled_once(spark):
    from helixframe.operators import rank

    hits = spark.createDataFrame([("a", 5, 1), ("a", 5, 0), ("a", 7, 0), ("b", 1, 2), ("b", 1, 2)], "name string, pos int, err int").repartition(3)
    best = rank.best_hits(hits, ["name"], [F.asc("err")], ["pos"])
    assert plan(best).count("Exchange hashpartitioning(") == 1
    assert sorted((r.name, r.pos, r.err, r.n_best) for r in best.collect()) == [("a", 5, 0, 2), ("a", 7, 0, 2), ("b", 1, 2, 1)]


@pytest.mark.parametrize("k,step", [(8, 1), (20, 20), (20, 7), (21, 5)])
def test_seeds_meet_by_bucket_as_by_equality(spark, k, step):
    from helixframe.functions import dna
    from helixframe.operators import seed

    rnd = random.Random(k)
    seqs = sequences(k, letters="ACGT" * 30 + "N") + ["ACGT" * 60]
    contigs = spark.createDataFrame([(c, dna_) for c, dna_ in enumerate(seqs)], "chrom_id bigint, seq string").repartition(3)
    reads = [(f"r{i}", s[a : a + rnd.randrange(10, 80)]) for i in range(80) for s in [rnd.choice(seqs)] for a in [rnd.randrange(max(len(s), 1))]] + [("n", None), ("e", "")]
    reads = spark.createDataFrame(reads, "name string, seq string")
    plain = seed.join(seed.seeds(reads, ["name"], "seq", k, step), seed.index(contigs, k, 500)).select("name", "offset", "chrom_id", "site", "kmer")
    for size in (500, 4096):
        made = seed.joined(reads, ["name"], contigs, k, step, size, spell=True)
        assert "Broadcast" not in plan(made)
        assert Counter(map(tuple, made.collect())) == Counter(map(tuple, plain.collect()))
    converted = reads.withColumn("seq", dna.convert(F.col("seq")))
    want = seed.join(seed.seeds(converted, ["name"], "seq", k, step), seed.strand_index(contigs, k))
    got = seed.strand_joined(converted, ["name"], contigs, k, step)
    names = ["name", "offset", "chrom_id", "strand", "length", "site"]
    assert Counter(map(tuple, got.select(names).collect())) == Counter(map(tuple, want.select(names).collect()))


def test_methylation_is_counted_as_reads_stream_by(spark):
    from helixframe.operators import methyl

    rnd = random.Random(46)
    seqs = {c: s for c, s in enumerate(sequences(46)) if s}
    contigs = spark.createDataFrame([(c, f"c{c}", s) for c, s in seqs.items()], "chrom_id int, name string, seq string")
    reads = [(rnd.choice((0, 0, 0, 5, 9)), rnd.randrange(2), rnd.randrange(-20, 2990), "".join(rnd.choice("ACGTN") for _ in range(rnd.randrange(0, 60)))) for _ in range(400)]
    where = {(r.chrom_id, r.pos): (r.base, r.context) for r in context.positions(contigs).collect()}
    want = {}
    for c, strand, site, seq in reads:
        for i, b in enumerate(seq):
            ref, kind = where.get((c, site + i), ("", 3))
            if kind < 3:
                x = want.setdefault((c, f"c{c}", site + i, kind), [0] * 5)
                own, turned = strand == (ref == "G"), {"C": "T", "G": "A"}[ref]
                x[0] += own and b == ref
                x[1] += own and b in (ref, turned)
                x[2] += own and b not in (ref, turned)
                x[3] += not own and b != ref
                x[4] += 1
    rows = spark.createDataFrame(reads, "chrom_id int, strand int, site int, seq string")
    for size in (64, 4096):
        counted = methyl.counts(rows, contigs, size)
        assert {tuple(r)[:4]: list(r)[4:] for r in counted.collect()} == want
        assert "posexplode" not in plan(counted)


def test_reads_are_cut_by_all_cores(spark):
    keys = synth.reads(spark, SF).select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(keys) > 1
