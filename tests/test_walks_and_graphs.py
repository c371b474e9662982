"""Goldens and brute-force versions of seeds, inference, alignments, induced graphs, transforms and formats."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from loomspan import session
from loomspan.functions import sequences, settings
from loomspan.operators import cigar, genotype, graph, induce, inference, intervals, msa, partition, projection, refine, seeds, similarity, syncmer
from loomspan.sources import text_formats, writers


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def plain_syncmers(s, k, n):
    out = []
    for i in range(len(s) - k + 1):
        mer = s[i : i + k]
        if set(mer) <= set("ACGT"):
            parts = [mer[j : j + n] for j in range(k - n + 1)]
            if parts.index(min(parts)) in (0, k - n):
                out.append((i, min(mer, rc(mer)), 1 if mer <= rc(mer) else -1))
    return out


@pytest.mark.parametrize("piece", [7, 1 << 18])
def test_syncmers_against_loops(spark, monkeypatch, piece):
    monkeypatch.setattr(syncmer, "PIECE", piece)
    random.seed(piece)
    rows = [(i, "".join(random.choice("ACGT" if i % 2 else "ACGTNa") for _ in range(random.randint(0, 120)))) for i in range(40)] + [(90, "A" * 50), (91, None), (92, "ACG")]
    got: dict = {}
    for r in syncmer.extract(spark.createDataFrame(rows, "path_id long, seq string"), 11, 4).orderBy("path_id", "step").collect():
        got.setdefault(r["path_id"], []).append((r["pos"], r["kmer"], r["orient"]))
        assert r["step"] == len(got[r["path_id"]]) - 1
    assert got == {i: p for i, s in rows if s and (p := plain_syncmers(s, 11, 4))}


def test_extraction_is_linear(spark):
    random.seed(1)
    seq = "".join(random.choices("ACGT", k=1_000_000))
    found = syncmer.extract(spark.createDataFrame([(1, seq)], "path_id long, seq string"), 31, 8)
    n, last = found.agg(F.count("*"), F.max("pos")).first()
    assert 0.8 * syncmer.density(24) < n / 1_000_000 < 1.3 * syncmer.density(24) and last > 999_900


@pytest.fixture(scope="module")
def shared_walks(spark):
    random.seed(3)
    core = "".join(random.choices("ACGT", k=400))
    own = ["".join(random.choices("ACGT", k=150)) for _ in range(4)]
    rows = [(1, own[0] + core), (2, core + own[1]), (3, rc(core) + own[2]), (4, own[3])]
    return dict(rows), syncmer.extract(spark.createDataFrame(rows, "path_id long, seq string"), 15, 6)


def test_ordered_seeds_meet_both_ways(shared_walks):
    texts, walk = shared_walks
    found = {(r["t_id"], r["strand"]) for r in seeds.seed_anchors(walk.where("path_id = 1"), walk, 3).collect()}
    assert found == {(2, "+"), (3, "-")}
    for r in seeds.seed_anchors(walk.where("path_id = 1"), walk, 3).collect():
        a, b = texts[1][r["q_pos"] : r["q_pos"] + 15], texts[r["t_id"]][r["t_pos"] : r["t_pos"] + 15]
        assert a == (b if r["strand"] == "+" else rc(b)) and r["n_steps"] == 3


def test_projected_ends(spark, shared_walks):
    texts, walk = shared_walks
    lengths = spark.createDataFrame([(i, len(t)) for i, t in texts.items()], "t_id long, length int")
    asked = spark.createDataFrame([(1, 200, 400)], "q_id long, q_from int, q_to int")
    got = {(r["t_id"], r["strand"]): (r["t_start"], r["t_end"]) for r in seeds.linear_ends(syncmer.anchors(walk, walk), asked, lengths, 15).collect()}
    assert got[(2, "+")] == (50, 250) and got[(3, "-")] == (150, 350)


def test_hops_reach_what_hops_reach(spark, shared_walks):
    _, walk = shared_walks
    asked = spark.createDataFrame([(7, 4, 0, 150), (8, 1, 200, 300)], "region_id long, path_id long, w_start int, w_end int")
    got = {(r["region_id"], r["depth"], r["t_id"]) for r in seeds.transitive(asked, walk, 15, 50, 2, max_depth=2).collect()}
    assert {(8, 0, 2), (8, 0, 3)} <= got and not any(g[0] == 7 for g in got) and (8, 1, 1) in got


def test_read_evidence_and_mosaics(spark):
    hits = spark.createDataFrame([("r1", 1, 10, 4), ("r1", 1, 11, 2), ("r1", 2, 20, 3), ("r2", 2, 20, 1), ("r2", 5, 50, 6)], "read_id string, locus_id int, cand_id int, hits int")
    support = {(r["locus_id"], r["cand_id"]): (r["read_weight"], r["anchor_weight"]) for r in inference.candidate_support(hits).collect()}
    assert support == {(1, 10): (0.5, 2.0), (1, 11): (0.5, 1.0), (2, 20): (2.0, 4.0), (5, 50): (1.0, 6.0)}
    links = {(r["cand_a"], r["cand_b"]): (r["read_weight"], r["anchor_weight"]) for r in inference.read_links(hits).collect()}
    assert links == {(10, 20): (0.5, 1.5), (11, 20): (0.5, 1.0), (20, 50): (1.0, 1.0)}
    orders = spark.createDataFrame([(1, 1, 2)], "a int, b int, c int").select(inference.phase_orders(["a", "b", "c"]).alias("p")).first()["p"]
    assert sorted(orders) == [[1, 1, 2], [1, 2, 1], [2, 1, 1]]


def test_stitched_mosaic_against_all_paths(spark):
    random.seed(8)
    combos = [(s, l, random.randint(0, 2), random.randint(0, 2), float(random.randint(0, 40))) for s in range(3) for l in range(4) if (s, l) != (1, 2)]
    combos += [(s, l, 2, 2, float(random.randint(0, 40))) for s in range(3) for l in range(4) if (s, l) != (1, 2)]
    cands = [(l, c, (f"p{(c + l // 2) % 3}", "+", l * 100, l * 100 + 100)) for l in range(4) for c in range(3)]
    df = spark.createDataFrame(combos, "sample_id int, locus_id int, c1 int, c2 int, qv double")
    table = spark.createDataFrame(cands, "locus_id int, cand_id int, at struct<path:string,strand:string,start:int,end:int>")
    states = inference.states(df, ["c1", "c2"])
    got: dict = {}
    for r in inference.stitched(states, table, 15.0, gap=1000).orderBy("sample_id", "locus_id").collect():
        got.setdefault(r["sample_id"], []).append((r["locus_id"], tuple(r["phases"]), r["score"]))
    path = {(l, c): p[0] for l, c, p in cands}
    for s in range(3):
        per = {}
        for r in states.where(F.col("sample_id") == s).collect():
            per.setdefault(r["locus_id"], []).append((tuple(r["phases"]), r["emission"]))
        loci = sorted(per)
        best = max(sum(e for _, e in way) - sum(15.0 * (path[a, x] != path[b, y]) for (a, p), (b, q) in zip(zip(loci, [w[0] for w in way]), list(zip(loci, [w[0] for w in way]))[1:]) for x, y in zip(p, q)) for way in itertools.product(*(per[l] for l in loci)))
        assert [g[0] for g in got[s]] == loci and got[s][0][2] == pytest.approx(best)


def test_alignment_rows(spark):
    rows = spark.createDataFrame([(1, 0, "a", "--ACG-T-"), (1, 1, "b", "-TACGGT-"), (2, 0, "c", "---")], "region_id int, row_id int, name string, aligned string")
    assert {r["region_id"]: (r["first"], r["last"]) for r in msa.trim_bounds(rows).collect()} == {1: (1, 7), 2: (0, 3)}
    assert sorted(r["aligned"] for r in msa.trimmed(rows.where("region_id = 1")).collect()) == ["-ACG-T", "TACGGT"]
    for seqs in (["ACGTACGT", "ACGTTACGT", "ACACGT"], ["AAAA"], ["ACGT", "", "ACGT"], ["GATTACA", "GCATGCT", "GATTTACA"]):
        done = msa.partial_order(seqs)
        assert [r.replace("-", "") for r in done] == seqs and len({len(r) for r in done}) == 1
    assert msa.partial_order(["ACGTACGT", "ACGTTACGT"]) in (["ACGT-ACGT", "ACGTTACGT"], ["ACG-TACGT", "ACGTTACGT"])


def plain_induced(seqs, pairs):
    """Union-find over oriented bases; the classes of bases that matches join."""
    parent: dict = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for q, qp, t, tp, back in pairs:
        for side in (0, 1):
            a, b = find((t, tp, side)), find((q, qp, side ^ back))
            parent[max(a, b)] = min(a, b)
    return {s: [min(find((s, i, 0)), find((s, i, 1))) for i in range(len(text))] for s, text in seqs.items()}


def test_induced_graph_against_union_find(spark):
    random.seed(11)
    core = "".join(random.choices("ACGT", k=40))
    seqs = {1: core, 2: core[:15] + "T" * 3 + core[15:], 3: rc(core), 4: core[:20] + "G" + core[21:], 5: "".join(random.choices("ACGT", k=12))}
    alns = [
        (1, 2, 0, 43, 1, 0, "+", "15=3I25="), (2, 3, 0, 40, 1, 0, "-", "40="), (3, 4, 0, 40, 1, 0, "+", "20=1X19=" if seqs[4][20] != core[20] else "40="), (4, 4, 0, 10, 2, 0, "+", "10="),
    ]
    aln = spark.createDataFrame(alns, "aln_id int, query_id int, qs int, qe int, target_id int, ts int, strand string, text string").withColumn("cigar", cigar.parse(F.col("text")))
    table = spark.createDataFrame(list(seqs.items()), "seq_id int, seq string")
    segments, links, steps = induce.induced(table, aln)
    assert {r["path_id"]: r["spelling"] for r in graph.spellings(segments, steps).collect()} == seqs
    pairs = []
    for r in aln.collect():
        t, q = r["ts"], (r["qe"] - 1 if r["strand"] == "-" else r["qs"])
        d = -1 if r["strand"] == "-" else 1
        for o in r["cigar"]:
            if o["op"] == "=":
                pairs += [(r["query_id"], q + d * i, r["target_id"], t + i, int(d < 0)) for i in range(o["len"])]
            t, q = t + (o["op"] != "I") * o["len"], q + d * (o["op"] != "D") * o["len"]
    classes = plain_induced(seqs, pairs)
    assert segments.agg(F.sum("len")).first()[0] == len({c for v in classes.values() for c in v})
    # Bases of one class are one base of the graph: paths meet in the same segments.
    own = {r["path_id"]: r["segs"] for r in steps.groupBy("path_id").agg(F.collect_set("seg_id").alias("segs")).collect()}
    assert set(own[1]) & set(own[3]) and set(own[1]) & set(own[2]) and not set(own[5]) & (set(own[1]) | set(own[2]))
    whole, _, walked = induce.unchopped(*graph.chopped(segments, steps, 3))
    assert {r["path_id"]: r["spelling"] for r in graph.spellings(whole, walked).collect()} == seqs
    assert whole.count() == segments.count()
    wrong = aln.where("aln_id = 1").withColumn("cigar", cigar.parse(F.lit("18=25=")))
    assert induce.longest_exact_run(wrong, table).first()["longest"] < 25


def test_interval_windows_across_stretches(spark, monkeypatch):
    random.seed(4)
    rows = [(k, a := random.randint(0, 900), a + random.randint(1, 60)) for k in (0, 1, None) for _ in range(150)] + [(5, 3, 800), (5, 10, 20), (5, 790, 810)]
    df = spark.createDataFrame(rows, "k int, a int, b int")
    want = {}
    for width in (16, 1 << 16):
        monkeypatch.setattr(intervals, "STRETCH", width)
        for name, out in (("merge", intervals.merge(df, ["k"], "a", "b", 2)), ("depth", intervals.depth_runs(df, ["k"], "a", "b")), ("contained", intervals.contained_dropped(df, ["k"], "a", "b")), ("less", intervals.subtract(df.where("a < 400"), df.where("a % 3 = 0"), ["k"], "a", "b"))):
            got = sorted(map(repr, out.collect()))
            assert got and want.setdefault(name, got) == got
    bases = {(k, x) for k, a, b in rows for x in range(a, b)}
    depth = intervals.depth_runs(df, ["k"], "a", "b").collect()
    assert sum(r["b"] - r["a"] for r in depth) == len(bases)
    assert intervals.merge(df, ["k"], "a", "b", -1).count() == len(rows) and "n_merged" in intervals.merge(df, ["k"], "a", "b", -1).columns


def test_subset_names(spark):
    seqs = spark.createDataFrame([(i, n) for i, n in enumerate(["A#1#c", "A#2#c", "B_hap1_x", "B#0#y:5-9", "plain", "C#1#z"])], "seq_id int, name string")
    pick = lambda *names: {r["seq_id"] for r in projection.named_by(seqs, spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    assert pick("A#1") == {0} and pick("A") == {0, 1} and pick("B") == {2, 3} and pick("plain:3-4") == {4} and pick("C#1#z") == {5} and pick("zz") == set()


def test_readers_refuse_what_is_wrong(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">a desc x>y\nACGT\n>b\nGG\n")
    assert sorted(map(tuple, text_formats.read_fasta(spark, str(tmp_path / "a.fa")).collect())) == [("a", "ACGT"), ("b", "GG")]
    (tmp_path / "no.paf").write_text("q\t9\t0\t9\t+\tt\t9\t0\t9\t9\t9\t60\n")
    with pytest.raises(Exception, match="cg tag"):
        text_formats.read_paf(spark, str(tmp_path / "no.paf")).collect()
    assert text_formats.read_paf(spark, str(tmp_path / "no.paf"), with_cigar=False).first()["cigar"] is None
    for text, message in (("S\ta\tAC\nS\ta\tG\n", "twice"), ("S\ta\t\n", "empty"), ("S\ta\tAC\nP\tp\ta+\t*\nP\tp\ta-\t*\n", "twice")):
        (tmp_path / "x.gfa").write_text(text)
        with pytest.raises(Exception, match=message):
            [t.collect() for t in text_formats.read_gfa(spark, str(tmp_path / "x.gfa"))]
    (tmp_path / "o.gfa").write_text("S\ta\tACG\nS\tb\tCGT\nS\tc\tTTT\nP\tp\ta+,b+,c+\t2M,1M\n")
    segments, _, steps = text_formats.read_gfa(spark, str(tmp_path / "o.gfa"))
    placed = graph.path_positions(segments.withColumnRenamed("name", "seg_id"), steps.withColumnsRenamed({"name": "seg_id", "path": "path_id"}))
    assert [(r["start"], r["end"]) for r in placed.orderBy("idx").collect()] == [(0, 3), (1, 4), (3, 6)]
    (tmp_path / "a.pack").write_text("1\t3\n2\t5\n1\t7\n3\t0\n")
    assert sorted(map(tuple, text_formats.read_pack(spark, str(tmp_path / "a.pack")).collect())) == [(1, 7), (2, 5)]
    reads = spark.createDataFrame([("r", 0, 3, [(9, "+")])], "read_id string, path_start int, path_end int, walk array<struct<seg_id:long,orient:string>>")
    with pytest.raises(Exception, match="no segment"):
        genotype.project_walks(reads, spark.createDataFrame([(1, 3)], "seg_id long, len int")).collect()
    assert text_formats.format_of("x.PAF.gz") == "paf" and text_formats.format_of("y.1aln") == "1aln" and text_formats.format_of("z.txt") is None
    with pytest.raises(ValueError):
        text_formats.file_list("list", ["x"], spark)


def test_graphs_of_several_files(spark, tmp_path):
    for n in "xy":
        (tmp_path / f"{n}.gfa").write_text(f"S\t1\tAC\nS\t2\tG\nL\t1\t+\t2\t-\t0M\nP\t{n}\t1+,2-\t*\n")
    segments, links, steps = text_formats.read_graphs(spark, [str(tmp_path / "x.gfa"), str(tmp_path / "y.gfa")])
    assert {r["name"] for r in segments.collect()} == {"0:1", "0:2", "1:1", "1:2"} and links.count() == 2 and steps.count() == 4


def test_index_comes_back(spark, tmp_path):
    aln = spark.createDataFrame([(i, 1, 0, 10, 2 + i % 5, i, i + 10, "+", [(10, "=")]) for i in range(50)], f"aln_id int, query_id int, qs int, qe int, target_id int, ts int, te int, strand string, cigar {cigar.TYPE}")
    found = projection.entries(aln)
    writers.write_index(found, str(tmp_path / "i"), 8)
    back = writers.read_index(spark, str(tmp_path / "i")).select(*found.columns)
    assert sorted(map(repr, back.collect())) == sorted(map(repr, found.collect()))
    names, dictionary = spark.createDataFrame([(i, f"n{i}") for i in range(1, 7)], "seq_id int, name string"), spark.createDataFrame([(100 + i, f"n{i}") for i in range(1, 7)], "seq_id int, name string")
    assert {r["query_id"] for r in writers.unified(aln, names, dictionary).collect()} == {101}


def test_partition_files(spark, tmp_path):
    names = spark.createDataFrame([(1, "a"), (2, "b")], "seq_id int, name string")
    parts = spark.createDataFrame([(1, 5, 0, 7), (2, 3, 9, 8)], "seq_id int, start int, stop int, part int")
    assert sorted(r["value"] for r in writers.partition_lines(parts, names, single=True).collect()) == ["a\t0\t5\t7", "b\t3\t9\t8"]
    writers.write_partitions(writers.partition_lines(parts, names), str(tmp_path / "p"), "bed")
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "p")).collect()) == ["a\t0\t5", "b\t3\t9"]
    with pytest.raises(ValueError):
        writers.write_partitions(writers.partition_lines(parts, names), str(tmp_path / "q"), "fasta", single=True)
    seqs = spark.createDataFrame([("a", "ACGTT")], "name string, seq string")
    ranges = spark.createDataFrame([("a", 0, 3, "-", 1)], "name string, start int, end int, strand string, part int")
    assert writers.partition_records(ranges, seqs).first()["value"] == ">a:0-3/rc\nCGT"
    with pytest.raises(Exception, match="no bases"):
        msa.members(ranges.withColumn("end", F.lit(9)), seqs).collect()


def test_bundles_and_reports(spark, tmp_path):
    counts = spark.createDataFrame([(2, 5), (1, 3)], "node_id long, cnt long")
    writers.write_projection(counts, str(tmp_path / "b"), {"graph_id": "x"})
    manifest, back = text_formats.read_projection(spark, str(tmp_path / "b"))
    assert manifest == {"kind": "projection", "graph_id": "x"} and sorted(map(tuple, back.collect())) == [(1, 3), (2, 5)]
    assert [r["value"] for r in writers.typed_pack_lines(counts, {"space": "gfa"}).collect()] == ["#space\tgfa", "#node\tcount", "1\t3", "2\t5"]
    figures = spark.createDataFrame([("b", 0.5), ("a", 2.0)], "metric string, value double")
    assert [r["value"] for r in writers.report_lines(figures, markdown=True).collect()] == ["| metric | value |", "|---|---|", "| a | 2 |", "| b | 0.5 |"]
    mosaic = spark.createDataFrame([(1, 0, 7), (1, 1, 7), (1, 2, 9)], "sample_id int, locus int, cand_id int")
    assert sorted(r["value"] for r in writers.mosaic_lines(mosaic).collect()) == ["1\t0\t1\t7", "1\t2\t2\t9"]
    assert writers.mosaic_records(mosaic, spark.createDataFrame([(7, "AC"), (9, "G")], "cand_id int, seq string")).first()["value"] == ">1\nACACG"
    walks = spark.createDataFrame([("s", 1, "c", 0, 5, [("a", "+"), ("b", "-")])], "sample string, hap int, contig string, start int, end int, walk array<struct<name:string,orient:string>>")
    assert writers.w_lines(walks).first()["value"] == "W\ts\t1\tc\t0\t5\t>a<b"


def test_settings(spark):
    assert [settings.round_figure(n) for n in (0, 1, 76, 520, 1700, 9900)] == [0, 50, 100, 500, 1800, 10000]
    assert [settings.filter_mode(t) for t in ("1:1", "many:many", "5:n", "x")] == [(1, 1), (None, None), (5, None), (1, 1)]
    assert settings.stages("Crush,max_span=5:smooth") == [("crush", {"max-span": "5"}), ("smooth", {})]
    for bad in ("a,b", "a,k=1,k=2", ":a"):
        with pytest.raises(ValueError):
            settings.stages(bad)
    assert settings.fnv1a() == 0xCBF29CE484222325
    a, b = spark.createDataFrame([(1, "A"), (2, "C")], "seg_id int, seq string"), spark.createDataFrame([(1, 0, 1)], "path_id int, idx int, seg_id int")
    assert settings.graph_id(a, b) == settings.graph_id(a.orderBy(F.desc("seg_id")), b) != settings.graph_id(a.limit(1), b)


def test_pieces_between_n(spark):
    df = spark.createDataFrame([("NNACNNNGNT",), ("",), ("NNNN",), ("AC",)], "s string")
    got = [[tuple(p) for p in r[0]] for r in df.select(sequences.cut_at_n(F.col("s"), 2)).collect()]
    assert got == [[(2, 4), (7, 10)], [], [], [(0, 2)]]
    assert [r[0] for r in spark.createDataFrame([(0.5,), (2.0,), (0.12345678,)], "v double").select(sequences.short_number(F.col("v"))).collect()] == ["0.5", "2", "0.1234568"]


def test_too_many_combinations_are_refused(spark):
    cand = spark.createDataFrame([(0, i, 1, 1) for i in range(30)], "locus_id int, cand_id int, feature_id int, weight long")
    pack = spark.createDataFrame([(0, 1, 2)], "locus_id int, feature_id int, cnt long")
    assert genotype.cosine_genotypes(cand, pack, 2, best=1).count() == 1
    with pytest.raises(Exception, match="combinations"):
        genotype.cosine_genotypes(cand, pack, 2, max_combinations=100).collect()


def test_rows_compare_by_bits_as_by_cells(spark):
    random.seed(6)
    rows = [(r, f"n{i}", "".join(random.choice("ACGT--") for _ in range(130))) for r in range(2) for i in range(6)]
    df = spark.createDataFrame(rows, "region_id int, name string, aligned string")
    plain = {}
    for (r, a, x), (q, b, y) in itertools.product(rows, rows):
        if r == q and a <= b and (n := sum(c == d != "-" for c, d in zip(x, y))):
            plain[r, a, b] = n
    assert {(r["region_id"], r["group_a"], r["group_b"]): r["shared"] for r in similarity.similarities(df).collect()} == plain
    guides = spark.createDataFrame([("n0",)], "grp string")
    axes = similarity.ordination(similarity.similarities(df))
    turned = similarity.polarized(axes, guides=guides)
    first = {(r["region_id"], r["pc"]): r["value"] for r in turned.where("grp = 'n0'").collect()}
    assert all(first[0, p] * first[1, p] >= -1e-12 for p in (1, 2) if (0, p) in first and (1, p) in first)
    assert turned.count() == axes.count()


def test_cut_tables_go_when_dropped(spark):
    import os

    held = session.cut(spark.range(5))
    path = held.cut_to
    assert held.count() == 5 and os.path.exists(path.removeprefix("file://"))
    session.dropped(held, spark.range(1))
    assert not os.path.exists(path.removeprefix("file://"))


def test_support_merges_on_either_side(spark):
    df = spark.createDataFrame([("k", 0, 10, 0, 10), ("k", 500, 510, 12, 20), ("k", 900, 910, 900, 910)], "k string, a int, b int, c int, d int")
    got = sorted((r["a"], r["b"], r["n_merged"]) for r in intervals.merge_either(df, ["k"], ("a", "b"), ("c", "d"), 5).collect())
    assert got == [(0, 510, 2), (900, 910, 1)]
