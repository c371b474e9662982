"""Goldens of graphs, coverage, genotypes, lacing and text formats."""

import pytest
from pyspark.sql import functions as F

from loomspan.functions import sequences
from loomspan.operators import genotype, graph, lace, partition, similarity, syncmer
from loomspan.plans import cohort_queries
from loomspan.sources import text_formats, writers


@pytest.fixture(scope="module")
def small(spark):
    segments = spark.createDataFrame([(1, 1, "A"), (2, 1, "C"), (3, 1, "G"), (4, 1, "T")], "seg_id long, len int, seq string")
    steps = spark.createDataFrame([(p, i, s, "+") for p, w in ((1, (1, 2, 4)), (2, (1, 3, 4))) for i, s in enumerate(w)], "path_id long, idx int, seg_id long, orient string")
    links = spark.createDataFrame([(1, "+", 2, "+"), (1, "+", 3, "+"), (2, "+", 4, "+"), (3, "+", 4, "+")], "from_id long, from_orient string, to_id long, to_orient string")
    return segments, links, steps


def test_heterozygote_wins(spark, small):
    cand = small[2].groupBy(F.lit(0).alias("locus_id"), F.col("path_id").alias("cand_id"), F.col("seg_id").alias("feature_id")).agg(F.count("*").alias("weight"))
    pack = spark.createDataFrame([(0, 1, 2), (0, 2, 1), (0, 3, 1), (0, 4, 2)], "locus_id int, feature_id long, cnt long")
    best = genotype.cosine_genotypes(cand, pack, 2, best=1).first()
    assert (best["c1"], best["c2"]) == (1, 2) and best["similarity"] == pytest.approx(1)
    homo = spark.createDataFrame([(0, 1, 2)], "locus_id int, feature_id long, cnt long")
    two = spark.createDataFrame([(0, 0, 1, 1), (0, 1, 2, 1)], "locus_id int, cand_id long, feature_id long, weight long")
    best = genotype.cosine_genotypes(two, homo, 2, best=1).first()
    assert (best["c1"], best["c2"], best["similarity"], best["qv"]) == (0, 0, 1.0, 999.0)


def test_walk_projection(spark, small, tmp_path):
    (tmp_path / "reads.gaf").write_text("".join(f"r{i}\t3\t0\t3\t+\t{w}\t3\t0\t3\t3\t3\t60\n" for i, w in enumerate((">1>2>1", ">1>3>4"))))
    reads = text_formats.read_gaf(spark, str(tmp_path / "reads.gaf"))
    visits = genotype.project_walks(reads.withColumn("walk", F.transform("walk", lambda s: F.struct(s["name"].cast("long").alias("seg_id"), s["orient"].alias("orient")))), small[0])
    assert {r["node_id"]: r["cnt"] for r in genotype.pack_counts(visits).collect()} == {1: 3, 2: 1, 3: 1, 4: 1}


def test_self_loop_normalisation_keeps_spellings(spark):
    segments = spark.createDataFrame([(1, 2, "AC"), (2, 1, "G")], "seg_id long, len int, seq string")
    steps = spark.createDataFrame([(7, i, s, o) for i, (s, o) in enumerate([(1, "+"), (2, "-"), (2, "-"), (2, "-"), (1, "+"), (1, "+")])], "path_id long, idx int, seg_id long, orient string")
    links = spark.createDataFrame([(2, "-", 2, "-"), (1, "+", 2, "-"), (2, "-", 1, "+")], "from_id long, from_orient string, to_id long, to_orient string")
    s2, _, t2 = graph.normalize_self_loops(segments, links, steps)
    assert graph.spellings(s2, t2).first()["spelling"] == graph.spellings(segments, steps).first()["spelling"] == "ACCCCACAC"
    assert t2.count() == 4


def test_bubbles_chains_components(spark, small):
    segments, links, steps = small
    assert [tuple(r) for r in graph.simple_bubbles(links).collect()] == [("1+", "4+", 2, 0)]
    assert {r["comp"] for r in graph.components(segments, links).collect()} == {1}
    assert len({r["chain"] for r in graph.linear_chains(links, segments).collect()}) == 4
    long_path = spark.createDataFrame([(i, "+", i + 1, "+") for i in range(1, 40)], links.schema)
    nodes = spark.createDataFrame([(i, 1, "A") for i in range(1, 42)], segments.schema)
    assert sorted({r["comp"] for r in graph.components(nodes, long_path).collect()}) == [1, 41]


def test_gfa_forms_agree(spark, tmp_path):
    head = "S\ts1\tAC\nS\ts2\tGGG\nS\ts3\tTA\nL\ts1\t+\ts2\t+\t0M\n"
    (tmp_path / "p.gfa").write_text(head + "P\tx\ts1+,s2-,s3+\t*\n")
    (tmp_path / "w.gfa").write_text(head + "W\tsmp\t1\tctg\t0\t7\t>s1<s2>s3\n")
    walks = [[(r["idx"], r["name"], r["orient"]) for r in text_formats.read_gfa(spark, str(tmp_path / f))[2].orderBy("idx").collect()] for f in ("p.gfa", "w.gfa")]
    assert walks[0] == walks[1] == [(0, "s1", "+"), (1, "s2", "-"), (2, "s3", "+")]


def test_formats(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">x one\nACG\nT\n>y\nGG\n")
    assert sorted(map(tuple, text_formats.read_fasta(spark, str(tmp_path / "a.fa")).collect())) == [("x", "ACGT"), ("y", "GG")]
    (tmp_path / "a.bed").write_text("c\t1\t5\nc\t2\t6\t.\nc\t3\t7\tn\n")
    assert sorted(r["name"] for r in text_formats.read_bed(spark, str(tmp_path / "a.bed")).collect()) == ["c:1-5", "c:2-6", "n"]
    (tmp_path / "bad.bed").write_text("c\t5\t1\n")
    with pytest.raises(Exception, match="start < end"):
        text_formats.read_bed(spark, str(tmp_path / "bad.bed")).collect()
    (tmp_path / "a.pack").write_text("#k\tv\n1\t3\n2\t0\n")
    assert [tuple(r) for r in text_formats.read_pack(spark, str(tmp_path / "a.pack")).collect()] == [(1, 3)]
    (tmp_path / "a.vcf").write_text("##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\nc:100-200\t5\t.\tA\tG\t.\t.\t.\tGT:DP\t0/1:3\t1/1:4\n")
    laced = lace.lace_vcf(text_formats.read_vcf(spark, str(tmp_path / "a.vcf"))).first()
    assert (laced["chrom"], laced["pos"], laced["genotypes"]) == ("c", 105, "0/1\t1/1")
    fasta = spark.createDataFrame([("n", "A" * 170)], "name string, seq string")
    assert [len(x) for x in writers.fasta_lines(fasta).first()["value"].split("\n")] == [2, 80, 80, 10]


def test_names(spark):
    df = spark.createDataFrame([("HG1#2#chr1", "a:1:5-9"), ("HG1_hap2_x", "a:9-5"), ("plain:1-2", "x")], "n string, r string")
    rows = df.select(sequences.pansn(F.col("n")).alias("p"), sequences.sample_and_haplotype(F.col("n")).alias("s"), sequences.region(F.col("r")).alias("r")).collect()
    assert [r["p"] and tuple(r["p"]) for r in rows] == [("HG1", "2", "chr1"), None, None]
    assert [tuple(r["s"]) for r in rows] == [("HG1", "2"), ("HG1", "2"), ("plain", None)]
    assert [r["r"] and tuple(r["r"]) for r in rows] == [("a:1", 5, 9), None, None]


def test_lis_and_lace(spark):
    df = spark.createDataFrame([([3, 1, 2, 2, 5, 4],), ([],)], "v array<bigint>")
    assert [r[0] for r in df.select(genotype.longest_increasing(F.col("v"))).collect()] == [3, 0]
    f = spark.createDataFrame([("k", 0, 10), ("k", 2, 8), ("k", 7, 15), ("k", 20, 30)], "key string, start int, stop int")
    assert [(r["kind"], r["start"], r["stop"]) for r in lace.lace(f).orderBy("idx").collect()] == [("range", 0, 10), ("range", 10, 15), ("gap", 15, 20), ("range", 20, 30)]


def test_rehome(spark):
    parts = spark.createDataFrame([(0, 0, 10, 1), (0, 10, 20, 2), (0, 20, 30, 3), (1, 0, 10, 3), (1, 50, 60, 1)], "seq_id int, start int, stop int, rank long")
    got = {(r["seq_id"], r["start"]): r["rank"] for r in partition.rehome_singletons(parts, ["rank"]).collect()}
    assert got[(0, 10)] == 1  # both flanks have two members; ties go left


def test_syncmers_meet_on_both_strands(spark):
    s = "ACGTTGCATGCCATAGGCATTACGGATCCATGCAATGGC"
    rc = s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    walk = syncmer.extract(spark.createDataFrame([(1, s), (2, rc), (3, "NN" + s)], "path_id long, seq string"), 9, 4)
    found = syncmer.chains(syncmer.anchors(walk.where("path_id = 1"), walk), 9, 30)
    strands = {(r["t_id"], r["strand"]): r["n_anchors"] for r in found.collect()}
    assert strands[(3, "+")] == walk.where("path_id = 1").count()
    assert (2, "-") in strands


def test_similarity_ratios(spark):
    msa = spark.createDataFrame([(0, "a#1", "ACG-"), (0, "a#2", "ACGT"), (0, "b#1", "TC-T")], "region_id int, name string, aligned string")
    rows = {(r["group_a"], r["group_b"]): r for r in similarity.similarities(msa).collect()}
    assert rows[("a#1", "a#2")]["shared"] == 3 and rows[("a#1", "a#2")]["jaccard"] == pytest.approx(0.75)
    assert rows[("a#1", "b#1")]["shared"] == 1
    axes = similarity.ordination(similarity.similarities(msa)).collect()
    assert {r["pc"] for r in axes} <= {1, 2} and len(axes) >= 3


def orders(spark, folder, paths):
    """Tables of orders (key, status and parts) and of parts 1 to 9."""
    spark.createDataFrame([(k, status) for k, status, _ in paths], "o_orderkey long, o_orderstatus string").write.parquet(f"{folder}/orders.parquet")
    lines = [(k, i, p, "N") for k, _, parts in paths for i, p in enumerate(parts, 1)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_returnflag string").write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(p, 30 + p) for p in range(1, 10)], "p_partkey long, p_size int").write.parquet(f"{folder}/part.parquet")
    return str(folder)


def test_unused_segments_looks_at_all_steps(spark, tmp_path):
    folder = orders(spark, tmp_path, [(1, "F", [1, 2, 3]), (2, "F", [4, 1]), (3, "O", [5, 6, 1]), (4, "P", [7])])
    assert {r["seg_id"] for r in cohort_queries.unused_segments(spark, folder).collect()} == {5, 6, 7, 8, 9}


def test_every_path_is_a_query(spark, tmp_path):
    folder = orders(spark, tmp_path, [(1, "F", [9, 8, 7]), (2, "P", [9, 8, 7]), (3, "O", [4, 8, 7])])
    walk = cohort_queries.syncmer_walks(spark, folder).collect()
    at = {k: {(r["kmer"], r["orient"], r["pos"]) for r in walk if r["path_id"] == k} for k in (1, 2, 3)}
    assert len(at[1]) > 1 and at[1] == at[2]
    both = {(p, q) for p in at for q in at if p != q}
    for query in (cohort_queries.syncmer_chains, cohort_queries.syncmer_matches):
        assert {(r["q_id"], r["t_id"]) for r in query(spark, folder).collect()} == both
    runs = plain_runs(walk)
    got = [tuple(r[c] for c in ("q_id", "t_id", "q_step", "t_step", "steps", "q_pos")) for r in cohort_queries.syncmer_matches(spark, folder).collect()]
    assert sorted(got) == sorted(runs)


def plain_runs(walk):
    """Maximal runs of two steps or more that two walks share in one direction with equal distances."""
    paths = {}
    for r in sorted(walk, key=lambda r: r["step"]):
        paths.setdefault(r["path_id"], []).append((r["kmer"], r["orient"], r["pos"]))
    out = []
    for p, x in paths.items():
        for q, y in paths.items():
            same = lambda i, j: 0 <= i < len(x) and 0 <= j < len(y) and x[i][:2] == y[j][:2]
            for i in range(len(x)):
                for j in range(len(y)):
                    follows = lambda a, b: same(a, b) and y[b][2] - x[a][2] == y[j][2] - x[i][2]
                    if p != q and same(i, j) and not follows(i - 1, j - 1):
                        n = 1
                        while follows(i + n, j + n):
                            n += 1
                        out += [(p, q, i, j, n, x[i][2])] if n > 1 else []
    return out
