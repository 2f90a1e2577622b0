"""Operators of the library proper: literals, brute force, round trips and the SQL of every query."""

import glob
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from helixframe.functions import cigar, dna, stats, text, variant
from helixframe.operators import align, baq, context, intervals, pileup, rank, seed, suffix, synth, variants, verify
from helixframe.plans import catalogue
from helixframe.sources import formats, readers, writers

SF = "/root/testdata/sf0.001"


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_bases(spark):
    s = F.lit("ACGTNacgt")
    assert one(spark, dna.reverse_complement(F.lit("AACGN")), dna.strict_reverse_complement(F.lit("AACGX")), dna.convert(F.lit("CCAT"))) == ("NCGTT", "NCGTT", "TTAT")
    assert one(spark, dna.positions_of(F.lit("CACC"), "C"), dna.positions_of(F.lit("AAA"), "C"), dna.last_position_of(F.lit("CAC"), "C"), dna.last_position_of(F.lit("AA"), "C")) == ([0, 2, 3], [], 2, -1)
    assert [tuple(x) for x in one(spark, dna.kmers(F.lit("ACGTNACG"), 3))[0]] == [(0, "ACG"), (1, "CGT"), (5, "ACG")]
    assert [tuple(x) for x in one(spark, dna.kmers(F.lit("ACGTACGT"), 3, 2))[0]] == [(0, "ACG"), (2, "GTA"), (4, "ACG")]
    assert one(spark, dna.kmer_code(F.lit("ACGT")), dna.kmer_code(F.lit("ACN")), dna.normalised(s)) == (27, -1, "ACGTNACGT")
    assert one(spark, dna.percent(F.lit(29), F.lit(100)), dna.percent(F.lit(0), F.lit(0)), dna.mismatch_penalty(F.lit(40)), dna.mismatch_penalty(F.lit(0))) == (28, 0, 6, 2)
    assert one(spark, dna.mate_name(F.lit("r1/1"), F.lit("r1/2")), dna.mate_name(F.lit("ab"), F.lit("ab")), dna.read_name(F.lit("@x y"))) == ("r1", "ab", "x")
    assert one(spark, dna.bisulfite_mismatches(F.lit("TTTA"), F.lit("CTCC")), dna.mask_overlap(F.lit("ACGT"), F.lit(2)), dna.mask_overlap(F.lit("AC"), F.lit(9))) == (1, "NNGT", "NN")


def test_cigars(spark):
    c = F.lit("2S3M1I2M2D1M")
    assert one(spark, cigar.query_length(c), cigar.reference_length(c), cigar.end_position(F.lit(0), F.lit(10), c), cigar.end_position(F.lit(4), F.lit(10), c), cigar.end_position(F.lit(0), F.lit(10), F.lit("*"))) == (9, 8, 18, 11, 11)
    assert one(spark, cigar.projected(F.lit("NNACGTACG"), c), cigar.projected(F.lit("ACG"), F.lit("1M2N2M"), "_")) == ("ACGACNNG", "A__CG")
    shown = one(spark, cigar.columns(F.lit(10), c, F.lit("NNACGTACG")))[0]
    assert [(x.pos, x.base, x.is_del, x.indel, x.is_head, x.is_tail) for x in shown] == [(10, "A", False, 0, True, False), (11, "C", False, 0, False, False), (12, "G", False, 1, False, False), (13, "A", False, 0, False, False), (14, "C", False, -2, False, False), (15, None, True, 0, False, False), (16, None, True, 0, False, False), (17, "G", False, 0, False, True)]
    assert one(spark, cigar.inserted(F.lit("NNACGTACG"), F.lit(4), F.lit(1))) == ("T",)
    assert one(spark, cigar.flag_names(F.lit(99)), cigar.flag_value(F.lit("PAIRED,READ1")), cigar.flag_value(F.lit("0x10")), cigar.flag_value(F.lit("NONE")), cigar.usable(F.lit(1024))) == ("PAIRED,PROPER_PAIR,MREVERSE,READ1", 65, 16, None, False)
    t = cigar.tags(F.array(F.lit("NM:i:3"), F.lit("XZ:Z:a:b"), F.lit("XB:B:c,1,-2"), F.lit("bad")))
    assert one(spark, cigar.tag_int(cigar.tag(t, "NM")), cigar.tag_string(cigar.tag(t, "XZ")), cigar.tag_array(cigar.tag(t, "XB")), cigar.tag_int(cigar.tag(t, "XZ")), cigar.tag_text(cigar.without_tag(t, "XB"))) == (3, "a:b", [1.0, -2.0], None, "NM:i:3\tXZ:Z:a:b")


def test_variants(spark):
    kinds = [("A", "C"), ("AC", "GT"), ("A", "AT"), ("AT", "A"), ("A", "A"), ("A", "<DEL>"), ("A", "A[chr1:5["), ("ACG", "TT"), ("A", ".")]
    got = [tuple(one(spark, variant.variant_type(F.lit(r), F.lit(a)))[0]) for r, a in kinds]
    assert got == [(1, 1), (2, 2), (4, 1), (4, -1), (0, 0), (8, 0), (16, 0), (8, -1), (0, 0)]
    gts = [[0, 0], [1, 1], [0, 1], [1, 2], [0], [1], [-1, 0], []]
    assert [one(spark, variant.genotype_type(F.array(*map(F.lit, g)).cast("array<int>")))[0] for g in gts] == [0, 1, 2, 3, 4, 5, 6, 6]
    assert one(spark, variant.diploid_index(F.lit(1), F.lit(2)), variant.has_filter(F.array().cast("array<string>"), "."), variant.add_filter(F.array(F.lit("PASS")), "q10")) == (4, True, ["q10"])
    assert one(spark, variant.sample_value(F.lit("GT:DP"), F.lit("0/1:7"), "DP"), variant.genotype(F.lit("0|.")), variant.sample_value(F.lit("GT"), F.lit("0/1"), "DP")) == ("7", [0, -1], None)
    assert one(spark, variant.renumbered(F.array(F.lit(0), F.lit(2), F.lit(1)), F.array(F.lit(2))), variant.record_problem(F.lit(5), F.lit("A"), F.array(F.lit("C")), F.array(F.lit(2)))) == ([0, 1, -1], "genotype beyond the alleles")
    rows = spark.createDataFrame([(1, "c", 5, "A", ["C", "G"]), (2, "c", 5, "A", ["G"]), (3, "c", 5, "A", ["T"]), (2, "c", 9, "A", ["T"])], "source int, chrom string, pos long, ref string, alts array<string>")
    some = {tuple(r.sources) for r in variants.synced(rows, 3, "some").collect()}
    assert some == {("A>C,G", "A>G", None), (None, None, "A>T"), (None, "A>T", None)}
    assert variants.synced(rows, 3, "any").count() == 2 and variants.synced(rows, 3).count() == 4


def test_statistics():
    assert [round(x, 6) for x in stats.fisher(3, 1, 1, 3)] == [0.985714, 0.242857, 0.485714]
    assert stats.fisher(0, 0, 3, 4) == (1.0, 1.0, 1.0)
    assert abs(stats.gamma_p(2, 3) - 0.8008517265) < 1e-9 and abs(stats.gamma_p(2.5, 0.3) + stats.gamma_q(2.5, 0.3) - 1) < 1e-12
    assert abs(stats.beta_i(2, 3, 0.4) - 0.5248) < 1e-12 and abs(stats.beta_i(5, 1, 0.9) - 0.9**5) < 1e-12
    import numpy as np

    gl = stats.ErrorModel().likelihoods(np.array([0] * 10 + [1] * 10), np.full(20, 30), np.array([True, False] * 10))
    assert gl.argmin() in (1, 4)


def test_suffix_order_and_transform():
    rnd = random.Random(9)
    for t in (b"", b"a", b"banana", b"aaaa", bytes(rnd.choices(b"ACGT", k=300))):
        order = suffix.suffix_array(t)
        assert suffix.proper(t, order) and suffix.inverted(*suffix.transformed(t)) == t
    assert suffix.found(b"banana", suffix.suffix_array(b"banana"), b"an") == (1, 3)


def test_base_alignment_quality(spark):
    import numpy as np

    rnd = random.Random(1)
    ref = "".join(rnd.choices("ACGT", k=80))
    read = ref[20:60]
    assert (baq.capped(read, np.full(40, 30), "40M", 20, ref)[2:-2] >= 29).all()
    short = read[:20] + read[22:]
    shifted = baq.capped(short, np.full(38, 30), "38M", 20, ref)
    assert (shifted[:15] >= 29).all() and (shifted[22:] == 0).all()
    assert (baq.capped(short, np.full(38, 30), "20M2D18M", 20, ref, True)[22:36] >= 29).all()
    assert baq.capped(read, np.full(40, 30), "20M5N20M", 20, ref) is None
    assert baq.mapping_cap(read, [30] * 40, "40M", 20, ref) == 40 and baq.mapping_cap("A" * 40, [30] * 40, "40M", 20, ref) == -1
    rows = spark.createDataFrame([(0, "c", 20, "38M", short, "?" * 38), (4, "c", 20, "38M", short, "?" * 38), (0, "x", 0, "38M", short, "*")], "flag int, rname string, pos int, cigar string, seq string, qual string")
    new = baq.realigned(rows, spark.createDataFrame([("c", ref)], "name string, seq string"))
    got = new.withColumn("back", baq.restored(F.col("qual"), F.col("bq"))).orderBy("rname", "flag").collect()
    assert got[0].back == "?" * 38 and got[0].qual != "?" * 38 and got[1].bq is None and got[2].qual == "*"


def test_numbers_and_strings(spark):
    assert one(spark, text.decimal(F.lit("1.5k")), text.decimal(F.lit("x")), text.percent_decoded(F.lit("a%2Bb+c")), text.every_place(F.lit("aaa"), "aa"), text.number_text(F.lit(1.5))) == (1500, None, "a+b+c", [0, 1], "1.5")


@pytest.mark.parametrize("bisulfite", [True, False])
def test_banded_distance_equals_full_matrix(bisulfite):
    rnd = random.Random(7)
    e, reads, windows = 4, [], []
    for _ in range(200):
        w = "".join(rnd.choice("ACGT") for _ in range(48))
        r = list(w[4:44])
        for _ in range(rnd.randrange(0, 4)):
            i = rnd.randrange(len(r))
            r[i : i + 1] = rnd.choice([["A"], [], ["C", "G"]])
        r = ("".join(r) + w[44:])[:40].replace("C", "T" if bisulfite and rnd.random() < 0.5 else "C")
        reads.append(r)
        windows.append(w)
    err, end, table = verify.distances(reads, windows, e, bisulfite)
    for (start, ops), r, w, d, stop in zip(verify.cigars(reads, windows, end, table, bisulfite), reads, windows, err, end):
        want, _ = verify.full_distance(r, w, bisulfite)
        if d < 0:
            assert want >= 3  # alignments that leave the band are not found
            continue
        assert d >= want and d <= e
        i, j, cost = 0, start, 0
        import re

        for n, op in ((int(a), b) for a, b in re.findall(r"(\d+)([MID])", ops)):
            if op == "M":
                cost += sum(not (r[i + k] == w[j + k] or (bisulfite and r[i + k] == "T" and w[j + k] == "C")) for k in range(n))
            else:
                cost += n
            i, j = i + n * (op != "D"), j + n * (op != "I")
        assert (i, j, cost) == (len(r), stop, d)


def test_affine_and_md():
    (score, start, end, ops), = verify.affine(["ACGTACGTAC"], ["TTACGTACGTACTT"], ["I" * 10], 2)
    assert (score, start, end, ops) == (0, 2, 12, "10M")
    (score, _, _, ops), = verify.affine(["ACGTTTACGGACTTGACCAT"], ["GGACGTTTACGGGACTTGACCATGG"[:24]], [""], 2)
    assert ops.count("D") == 1 and score == -8
    assert verify.without_edge_insertions("2I5M1I") == "8M" and verify.trimmed("NNACN") == (2, 4)
    assert verify.md_string("ACGTA", "ACCTGA", "4M1D1M") == ("2C1^G1", 2)


def test_reads_are_mapped_to_their_places(spark):
    reads = synth.reads(spark, SF)
    hits = align.map_single(reads.select("name", "seq"), synth.contigs(spark, SF))
    joined = reads.join(hits, "name")
    n = reads.count()
    right = joined.where((F.col("strand") == 0) & (F.col("site") == F.col("true_site")) & (hits["chrom_id"] == reads["chrom_id"])).count()
    assert right >= 0.97 * n and rank.unmapped(reads, hits, ["name"]).count() <= 0.02 * n


def test_reverse_reads_are_mapped(spark):
    contigs = synth.contigs(spark, SF).limit(20)
    rows = [(f"r{i}", r.chrom_id, s, r.seq[s : s + 100].translate(str.maketrans("ACGT", "TGCA"))[::-1].replace("C", "T")) for i, r in enumerate(contigs.collect()) for s in (0, 300, 924)]
    reads = spark.createDataFrame([(f"{n}-{s}", q) for n, _, s, q in rows], "name string, seq string")
    got = {r.name: (r.chrom_id, r.strand, r.site) for r in align.map_single(reads, contigs).collect()}
    assert got == {f"{n}-{s}": (c, 1, s) for n, c, s, _ in rows}


def test_bins_equal_nested_loops(spark):
    rnd = random.Random(3)
    make = lambda n: [(rnd.choice("ab"), b := rnd.randrange(0, 3000), b + rnd.randrange(1, 400), i) for i in range(n)]
    a, b = make(60), make(50)
    schema = "chrom string, beg long, end long, id int"
    left, right = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    pairs = Counter((r.l_id, r.r_id) for r in intervals.overlap_join(left, right, 128).collect())
    want = Counter((x[3], y[3]) for x in a for y in b if x[0] == y[0] and x[1] < y[2] and x[2] > y[1])
    assert pairs == want
    assert {r.id for r in intervals.overlap_semi(left, right, 128).collect()} == {x for x, _ in want}
    assert {r.id for r in intervals.overlap_semi(left, right, 128, anti=True).collect()} == {x[3] for x in a} - {x for x, _ in want}
    for r in intervals.coverage(left).collect():
        assert r.depth == sum(x[0] == r.chrom and x[1] <= r.beg and x[2] >= r.end for x in a)


def test_seeds_and_candidates(spark):
    genome = spark.createDataFrame([(0, "ACGT" * 10 + "TTGACCATGGCA")], "chrom_id int, seq string")
    index = seed.index(genome, 8)
    assert seed.frequent(index, 5).count() == 4
    joined = seed.join(seed.seeds(spark.createDataFrame([("r", "TTGACCATGGCA")], "name string, seq string"), ["name"], "seq", 8), index, 5)
    assert [(r.diagonal, r.votes) for r in seed.votes(joined, ["name", "chrom_id"]).collect()] == [(40, 5)]
    assert [(r.offset, r.length) for r in seed.longest(joined, ["name", "chrom_id"], k=8).collect()] == [(0, 12)]


def test_pileup_text_takes_all_reads_of_a_place(spark, monkeypatch):
    from helixframe.plans import records

    rows = spark.range(8001).select(F.format_string("r%05d", "id").alias("qname"), F.lit(0).alias("flag"), F.lit("c").alias("rname"), F.lit(0).alias("pos"), F.lit("1M").alias("cigar"), F.lit("A").alias("seq"), F.lit("I").alias("qual"))
    monkeypatch.setattr(records, "alignments", lambda spark, sf_dir: rows)
    assert [(r.depth, len(r.bases)) for r in records.pileup_text(spark, "").collect()] == [(8001, 8001)]


def test_pileup_and_mates(spark):
    rows = [("a", 99, "z", 4, "5M", 7, "ACGTA", "IIIII"), ("a", 147, "z", 6, "2M1D2M", -7, "GTCC", "!III"), ("b", 4, "z", 4, "5M", 0, "AAAAA", "IIIII")]
    records = spark.createDataFrame(rows, "qname string, flag int, rname string, pos int, cigar string, tlen int, seq string, qual string")
    lines = {r.pos: (r.depth, r.bases) for r in pileup.text(pileup.columns(records)).collect()}
    assert lines == {4: (1, "A"), 5: (1, "C"), 6: (2, "GG"), 7: (2, "TT-1"), 8: (2, "A-"), 9: (1, "C"), 10: (1, "C")}
    merged = {(r.pos, r.flag): r.qual for r in pileup.merged_overlaps(pileup.columns(records)).collect()}
    assert merged[6, 99] == 40 and merged[6, 147] == 0 and merged[7, 99] == 80
    assert pileup.mates(records).count() == 1


def test_text_formats_round_trip(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">one first\nacgt\nNN\n\n>two\n>three x\nTT\n")
    assert [(r.name, r.seq) for r in readers.fasta(spark, str(tmp_path / "x.fa")).collect()] == [("one", "ACGTNN"), ("two", ""), ("three", "TT")]
    contigs = spark.createDataFrame([("c1", "ACGT" * 40), ("c2", "A")], "name string, seq string")
    writers.write_fasta(contigs, str(tmp_path / "fa"))
    assert {tuple(r) for r in readers.fasta(spark, str(tmp_path / "fa")).collect()} == {tuple(r) for r in contigs.collect()}
    sam = [("r1", 99, "c1", 4, 60, "5M", "=", 9, 20, "ACGTA", "IIIII", {"NM": ("i", "1"), "XZ": ("Z", "a b")}), ("r2", 4, "*", -1, 0, "*", "*", -1, 0, "*", "*", {})]
    records = spark.createDataFrame(sam, formats.SAM)
    writers.write_sam(records, str(tmp_path / "sam"), [("c1", 160), ("c2", 1)])
    assert {str(r) for r in readers.sam(spark, str(tmp_path / "sam")).collect()} == {str(r) for r in records.collect()}
    assert {r.fields["SN"] for r in readers.sam_header(spark, str(tmp_path / "sam")).where("kind = 'SQ'").collect()} == {"c1", "c2"}
    formats.register(spark)
    records.write.format("bam").option("contigs", "c1:160,c2:1").mode("append").save(str(tmp_path / "bam"))
    assert {str(r) for r in spark.read.format("bam").load(str(tmp_path / "bam")).collect()} == {str(r) for r in records.collect()}
    (tmp_path / "x.vcf").write_text('##fileformat=VCFv4.2\n##INFO=<ID=DP,Number=1,Type=Integer,Description="d">\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\n1\t5\t.\tA\tC,T\t9\tPASS\tDP=3;DB\tGT\t0/1\t./.\n1\t7\tx\tAT\tA\t.\t.\t.\tGT\t0\t1\n')
    vcf = readers.vcf(spark, str(tmp_path / "x.vcf"))
    writers.write_vcf(vcf, str(tmp_path / "vcf"), ['##INFO=<ID=DP,Number=1,Type=Integer,Description="d">'], readers.vcf_samples(spark, str(tmp_path / "x.vcf")))
    again = readers.vcf(spark, str(tmp_path / "vcf"))
    assert [str(r) for r in again.orderBy("pos").collect()] == [str(r) for r in vcf.orderBy("pos").collect()] and vcf.count() == 2
    assert [r.id for r in readers.vcf_header(spark, str(tmp_path / "vcf")).collect()] == ["DP"]
    (tmp_path / "x.bed").write_text("track x\nchr1\t5\t9\tn\nchr1\t7\n")
    assert [(r.beg, r.end) for r in readers.bed(spark, str(tmp_path / "x.bed")).collect()] == [(5, 9), (7, 8)]
    (tmp_path / "x.gff").write_text("#c\nchr1\ts\tgene\t5\t9\t.\t+\t.\tID=a;Name=b\n")
    (row,) = readers.gff(spark, str(tmp_path / "x.gff")).collect()
    assert (row.beg, row.end, row.attributes) == (4, 9, {"ID": "a", "Name": "b"})
    assert readers.delimited(spark, str(tmp_path / "x.gff"), "gff").first()["beg"] == 4 and readers.kind_of("a/B.FQ.gz") == "fastq"
    rows = spark.createDataFrame([("CpG", "c1", 4, 5, 28, 29, 71)], "context string, chrom string, beg long, end long, pct int, n_meth long, n_unmeth long")
    writers.write_bedgraph(rows, str(tmp_path / "bg"))
    assert [r.value for r in spark.read.text(str(tmp_path / "bg" / "CpG")).collect()][-1] == "c1\t4\t5\t28\t29\t71"


def test_fastq_in_any_ranges(spark, tmp_path):
    import gzip

    formats.register(spark)
    rnd = random.Random(1)
    sizes = [rnd.randrange(1, 30) for _ in range(200)]
    reads = [(f"r{i}/1 x", "".join(rnd.choices("ACGT", k=n)), "".join(rnd.choices("@+IJ!", k=n))) for i, n in enumerate(sizes)]
    data = "".join(f"@{a}\n{b}\n+\n{c}\n" for a, b, c in reads)
    (tmp_path / "a.fq").write_text(data)
    with gzip.open(tmp_path / "b.fastq.gz", "wt") as f:
        f.write(data.replace("/1 x", "/2 x"))
    for size in (64, 1000, 1 << 20):
        got = spark.read.format("fastq").option("rangebytes", size).load(str(tmp_path / "a.fq")).orderBy("at").collect()
        assert [(r.name, r.seq, r.qual) for r in got] == reads
    pairs = formats.fastq_pairs(spark, str(tmp_path / "a.fq"), str(tmp_path / "b.fastq.gz")).collect()
    assert {r.name for r in pairs} == {f"r{i}" for i in range(200)}
    with pytest.raises(Exception):
        spark.read.format("fastq").load(str(tmp_path / "missing.fq")).collect()


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_queries_equal_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    norm = lambda v: round(v, 9) if isinstance(v, float) else tuple(map(norm, v)) if isinstance(v, list | tuple) else v
    df = catalogue.QUERIES[name](spark, SF)
    result = con.sql(catalogue.ORACLES[name])
    assert sorted(df.columns) == sorted(result.columns)
    at = [result.columns.index(c) for c in sorted(result.columns)]
    want = Counter(tuple(norm(r[i]) for i in at) for r in result.fetchall())
    assert Counter(tuple(norm(r[c]) for c in sorted(df.columns)) for r in df.collect()) == want
    assert want


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_other_queries_run(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_pieces_of_contigs_equal_the_whole(spark):
    rnd = random.Random(31)
    seqs = ["".join(rnd.choice("ACGTN" if i else "ACGT") for _ in range(n)) for i, n in enumerate((5000, 1023, 1024, 1, 0, 2049))]
    contigs = spark.createDataFrame(list(enumerate(seqs)), "chrom_id int, seq string")
    turn = str.maketrans("ACGT", "TGCA")
    for size in (64, 1024):
        got = {(r.chrom_id, r.pos): (r.base, r.context) for r in context.positions(contigs, size).collect()}
        want = {}
        for c, s in enumerate(seqs):
            for i, b in enumerate(s):
                one, two = (s[i + 1 : i + 2], s[i + 2 : i + 3]) if b == "C" else (s[i - 1 : i] if i else "", s[i - 2 : i - 1] if i > 1 else "")
                mate = "G" if b == "C" else "C"
                want[c, i] = (b, 3 if b not in "CG" else 0 if one == mate else 1 if two == mate else 2)
        assert got == want
        for r in context.strand_chunks(contigs, size, 30).collect():
            whole = seqs[r.chrom_id].translate(turn)[::-1] if r.strand else seqs[r.chrom_id]
            assert r.seq == whole[r.chunk_start : r.chunk_start + size + 30] and r.length == len(whole)
    kmers = Counter((r.chrom_id, r.site, r.kmer) for r in seed.index(contigs, 8, 64).collect())
    assert kmers == Counter((c, i, s[i : i + 8]) for c, s in enumerate(seqs) for i in range(len(s) - 7) if "N" not in s[i : i + 8])


def test_reads_with_unknown_bases_and_gaps_become_records(spark, tmp_path):
    rnd = random.Random(32)
    contig = "".join(rnd.choice("ACGT") for _ in range(3000))
    contigs = spark.createDataFrame([(1, "c", contig), (2, "d", contig[1000:1500])], "chrom_id int, name string, seq string")
    turn = str.maketrans("ACGT", "TGCA")
    with_n = contig[200:250] + "N" + contig[251:300]
    gap = contig[500:550] + contig[552:602]
    more = contig[700:750] + "GG" + contig[750:798]
    rows = [("n", with_n), ("gap", gap), ("more", more), ("back", contig[2000:2100].translate(turn)[::-1]), ("two", contig[1100:1200]), ("none", "ACAC" * 25), ("short", "ACGT")]
    reads = spark.createDataFrame([(n, s, "I" * len(s)) for n, s in rows], "name string, seq string, qual string")
    got = {r.qname: r for r in align.mapped(reads, contigs).collect()}
    place = {n: (r.flag, r.rname, r.pos, r.cigar) for n, r in got.items()}
    assert place["n"] == (0, "c", 200, "100M") and got["n"].tags["NM"].value == "1" and got["n"].tags["MD"].value == f"50{contig[250]}49"
    assert place["gap"][:3] == (0, "c", 500) and got["gap"].cigar.count("2D") == 1 and got["gap"].tags["NM"].value == "2"
    assert place["more"][:3] == (0, "c", 700) and got["more"].cigar.count("2I") == 1
    assert place["back"] == (16, "c", 2000, "100M") and got["back"].seq == contig[2000:2100] and got["back"].tags["MD"].value == "100"
    assert place["two"][:3] == (0, "c", 1100) and got["two"].mapq == 0 and got["two"].tags["XB"].value == "2"
    assert got["n"].mapq > 0 and got["back"].mapq == 42 >= got["n"].mapq
    assert place["none"] == (4, "*", -1, "*") and place["short"][0] == 4
    writers.write_sam(align.mapped(reads, contigs), str(tmp_path / "out"), [("c", 3000), ("d", 500)])
    back = {r.qname: (r.flag, r.rname, r.pos, r.cigar) for r in readers.sam(spark, str(tmp_path / "out")).collect()}
    assert back == place


def test_pairs_of_other_protocols(spark):
    rnd = random.Random(33)
    contig = "".join(rnd.choice("ACGT") for _ in range(2000))
    contigs = spark.createDataFrame([(1, contig)], "chrom_id int, seq string")
    turn = str.maketrans("ACGT", "TGCA")
    one = spark.createDataFrame([("p", contig[300:400].replace("C", "T"))], "name string, seq string")
    two = spark.createDataFrame([("p", contig[420:520].replace("C", "T").translate(turn)[::-1])], "name string, seq string")
    want = [("p", 300, 420, 0, 1, 220, 0, 1)]
    pick = lambda df: [(r.pair_id, r.start1, r.start2, r.strand1, r.strand2, r.tlen, r.errors, r.n_best) for r in df.collect()]
    assert pick(align.map_pairs(one, two, contigs)) == want == pick(align.map_pairs(two, one, contigs, pbat=True, sensitive=True))
    assert pick(align.map_pairs(one, two, contigs, high=200)) == []
    worn = spark.createDataFrame([("w", "".join(c if i % 19 else {"A": "G", "C": "A", "G": "A", "T": "G"}[c] for i, c in enumerate(contig[900:1000])))], "name string, seq string")
    assert align.map_single(worn, contigs).count() == 0 and align.map_single(worn, contigs, k=16, sensitive=True).first().site == 900


@pytest.mark.parametrize("width", [1, 16, 1 << 14])
def test_islands_and_depths_in_bins_of_any_width(spark, width):
    rnd = random.Random(width)
    rows = [(rnd.choice("ab"), b := rnd.randrange(-50, 900), b + rnd.choice((0, 1, 5, 200)), i) for i in range(70)]
    df = spark.createDataFrame(rows, "chrom string, beg long, end long, id int")
    want = []
    for c in "ab":
        for b, e in sorted((b, e) for x, b, e, _ in rows if x == c):
            if want and want[-1][0] == c and b <= want[-1][2]:
                want[-1][2] = max(want[-1][2], e)
            else:
                want.append([c, b, e])
    assert sorted([r.chrom, r.beg, r.end] for r in intervals.merged(df, width=width).collect()) == sorted(want)
    got = sorted((r.chrom, r.beg, r.end, r.depth) for r in intervals.coverage(df, width=width).collect())
    for c, b, e, d in got:
        assert {sum(x[0] == c and x[1] <= p < x[2] for x in rows) for p in (b, e - 1)} == {d}
    covered = {(c, p) for c, b, e, _ in got for p in range(b, e)}
    assert covered == {(c, p) for c, b, e, _ in rows for p in range(b, e)} and all(x[:1] != y[:1] or x[2] < y[1] or x[3] != y[3] for x, y in zip(got, got[1:]))
