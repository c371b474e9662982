"""Queries over induced graphs, multiple alignments, transforms and closures with conditions, and what DuckDB must get."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions import sequences
from loomspan.operators import align, cigar, graph, induce, lace, msa, partition, projection, refine, transforms
from loomspan.plans import alignment_queries, cohort_queries, domain, walk_queries  # noqa: F401  (the last one's views are used here)
from loomspan.plans.alignment_queries import hits_sql, merge_sql
from loomspan.plans.domain import duck


def _hap_alignments(spark: SparkSession, sf_dir: str, known: dict) -> DataFrame:
    """Outer pieces aligned to the haplotype before of the nation, with the middle one as a mismatch; the middle piece to the one before that has it."""
    pairs = domain.view(spark, sf_dir, "hap_pairs", known)

    def ops(*parts: tuple[int, str]):
        return F.array(*(F.struct(F.lit(n).alias("len"), F.lit(o).alias("op")) for n, o in parts))

    outer = pairs.where("outer_id is not null").select("query_id", F.lit(0).alias("qs"), F.lit(60).alias("qe"), F.col("outer_id").alias("target_id"), F.lit(0).alias("ts"), F.lit(60).alias("te"), F.lit("+").alias("strand"), ops((20, "="), (20, "X"), (20, "=")).alias("cigar"))
    middle = pairs.where("middle_id is not null").select("query_id", F.lit(20).alias("qs"), F.lit(40).alias("qe"), F.col("middle_id").alias("target_id"), F.lit(20).alias("ts"), F.lit(40).alias("te"), F.lit("+").alias("strand"), ops((20, "=")).alias("cigar"))
    return outer.unionByName(middle).withColumn("aln_id", F.xxhash64("query_id", "target_id", "qs"))


def _induced(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    known: dict = {}
    return induce.induced(domain.view(spark, sf_dir, "haps", known).select("seq_id", "seq"), _hap_alignments(spark, sf_dir, known), 5)


def induced_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paths of the graph induced from the haplotypes' alignments: they spell the haplotypes, through three segments each, or one where a nation has one haplotype."""
    segments, _, steps = _induced(spark, sf_dir)
    n = steps.groupBy("path_id").agg(F.count("*").alias("n_steps"))
    return graph.spellings(segments, steps).join(n, "path_id")


def induced_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The induced graph's segments and how many paths pass through each."""
    segments, _, steps = _induced(spark, sf_dir)
    return segments.join(steps.groupBy("seg_id").agg(F.count_distinct("path_id").alias("n_paths")), "seg_id").select("seq", "n_paths")


def smoothed_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings after the induced graph's blocks were aligned anew: the haplotypes."""
    segments, _, steps = transforms.smoothed(*_induced(spark, sf_dir), targets=(40,))
    return graph.spellings(segments, steps)


def crushed_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings after the induced graph's bubbles were crushed: the haplotypes."""
    segments, _, steps = transforms.crushed(*_induced(spark, sf_dir))
    return graph.spellings(segments, steps)


def pipeline_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings after chopping, joining and sorting the graph."""
    known: dict = {}
    segments, _, steps = transforms.run("chop,most=8:unchop:sort", *(domain.view(spark, sf_dir, n, known) for n in ("segments", "links", "steps")))
    return graph.spellings(segments, steps)


def laced_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Haplotypes as two windows each, which overlap in even ones and leave a gap in odd ones, laced to whole paths."""
    haps = domain.view(spark, sf_dir, "haps")
    even = F.col("seq_id") % 2 == 0
    windows = haps.select("seq_id", "seq", F.explode(F.array(F.struct(F.lit(0).alias("a"), F.when(even, 40).otherwise(20).alias("b")), F.struct(F.when(even, 25).otherwise(30).alias("a"), F.lit(60).alias("b")))).alias("w"))
    named = windows.select(F.format_string("h%d:%d-%d", "seq_id", "w.a", "w.b").alias("path_id"), F.substr("seq", F.col("w.a") + 1, F.col("w.b") - F.col("w.a")).alias("seq"), (F.col("w.a") == 0).alias("first"))
    # The second windows' segments are stored backwards.
    segments = named.select(F.col("path_id").alias("seg_id"), F.length("seq").alias("len"), F.when(F.col("first"), F.col("seq")).otherwise(sequences.reverse_complement(F.col("seq"))).alias("seq"))
    steps = named.select("path_id", F.lit(0).alias("idx"), F.col("path_id").alias("seg_id"), F.when(F.col("first"), "+").otherwise("-").alias("orient"))
    new, _, walked = lace.lace_graphs(segments, steps, haps.select(F.format_string("h%d", "seq_id").alias("key"), "seq"))
    n = walked.groupBy("path_id").agg(F.count("*").alias("n_steps"))
    return graph.spellings(new, walked).join(n, "path_id")


def laced_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window for each supplier, a sample for each line number; a third of the calls have a depth beside the genotype."""
    calls = domain.view(spark, sf_dir, "aln_base").select(
        F.format_string("c%d:%d-%d", F.col("query_id"), F.col("query_id") * 1000, F.col("query_id") * 1000 + 1000).alias("chrom"), (F.col("ts") % 1000 + 1).cast("long").alias("pos"),
        F.lit("A").alias("ref"), F.when(F.col("strand") == "-", "C").otherwise("G").alias("alt"), F.format_string("s%d", F.col("n_ins")).alias("sample"),
        F.when(F.col("n_x") == 1, "GT:DP").otherwise("GT").alias("format"),
        F.concat(F.when(F.col("n_del") > 3, "0/1").otherwise("1/1"), F.when(F.col("n_x") == 1, F.concat(F.lit(":"), F.col("m2").cast("string"))).otherwise("")).alias("call"))
    return lace.lace_vcf_records(calls)[1]


def rendered_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bases 1005 to 1030 of each path's source, which begins at 1000, in the rendered path."""
    known: dict = {}
    positions = graph.path_positions(domain.view(spark, sf_dir, "segments", known), domain.view(spark, sf_dir, "steps", known))
    sources = positions.select("path_id").distinct().select("path_id", F.concat(F.lit("src"), F.col("path_id").cast("string")).alias("source"), F.lit(1000).alias("offset"))
    asked = sources.select(F.col("path_id").alias("range_id"), "source", F.lit(1005).alias("r_start"), F.lit(1030).alias("r_end"))
    return transforms.rendered_ranges(asked, transforms.translation(positions, sources))


def anchored_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each haplotype on the one before of its nation, its outer pieces held fast by two anchors of 15 bases."""
    known: dict = {}
    seqs = domain.view(spark, sf_dir, "haps", known)
    q, t = (seqs.select(F.col("seq_id").alias(f"{k}_id"), F.col("seq").alias(f"{n}_seq")) for k, n in (("query", "query"), ("outer", "target")))
    pairs = domain.view(spark, sf_dir, "hap_pairs", known).where("outer_id is not null").join(q, "query_id").join(t, "outer_id")
    done = align.align_anchored(pairs.withColumn("anchors", F.array(*(F.struct(F.lit(x).alias("q"), F.lit(x).alias("t")) for x in (2, 43)))), 15)
    ops = cigar.parse(F.col("cigar"))
    return done.select("query_id", "outer_id", cigar.query_span(ops).alias("q_span"), cigar.target_span(ops).alias("t_span"), (F.col("cost") <= align.most_cost(F.col("query_seq"), F.col("target_seq"))).alias("cheap"))


def absorbed_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partitions' ranges of under 500 bases given to their neighbours."""
    return partition.absorbed(cohort_queries.partition_windows(spark, sf_dir), 500, ("rank",))


def sketched_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each path with the three others whose sketches share most; hashes of Spark's, so rows only."""
    return align.sketch_pairs(cohort_queries._walks(spark, sf_dir), 8, 3)


def exact_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest run of matches of each haplotype alignment that the bases bear out."""
    known: dict = {}
    aln = _hap_alignments(spark, sf_dir, known)
    found = induce.longest_exact_run(aln, domain.view(spark, sf_dir, "haps", known).select("seq_id", "seq"))
    return aln.select("aln_id", "query_id", "target_id", "qs").join(found, "aln_id").drop("aln_id")


def unchopped_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings after segments that all paths pass through together were joined, with the new numbers of steps."""
    known: dict = {}
    parts = [domain.view(spark, sf_dir, n, known) for n in ("segments", "links", "steps")]
    segments, _, steps = induce.unchopped(*graph_chopped(parts))
    return graph.spellings(segments, steps)


def graph_chopped(parts: list[DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    segments, _, steps = parts
    return graph.chopped(segments, steps, 8)


def chopped_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps through segments of at most eight bases."""
    known: dict = {}
    _, _, steps = graph_chopped([domain.view(spark, sf_dir, n, known) for n in ("segments", "links", "steps")])
    return steps.select("path_id", "idx", "seg_id", "orient")


def _loci(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A customer's orders as the paths of a small graph of its own."""
    known: dict = {}
    of = domain.view(spark, sf_dir, "orders", known).select(F.col("o_custkey").alias("region_id"), F.col("o_orderkey").alias("path_id"))
    steps = domain.view(spark, sf_dir, "steps", known).join(of, "path_id")
    segments = steps.select("region_id", "seg_id").distinct().join(domain.view(spark, sf_dir, "segments", known), "seg_id")
    return segments, steps


def graph_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as rows over its parts."""
    return msa.from_graph(*_loci(spark, sf_dir))


def _msa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain.view(spark, sf_dir, "msa").withColumns({"start": F.col("row_id") * 10, "strand": F.lit("+"), "length": F.lit(1000)})


def trim_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return msa.trim_bounds(_msa(spark, sf_dir))


def maf_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return msa.maf_blocks(_msa(spark, sf_dir))


def fasta_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return msa.fasta_alignment(_msa(spark, sf_dir), 20)


def core_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments without the columns that only three bases of padding at either end fill."""
    rows = domain.view(spark, sf_dir, "msa")
    padding = rows.select("region_id", "row_id", F.lit(3).alias("left"), F.lit(3).alias("right"))
    return msa.core_columns(rows, padding).select("region_id", "row_id", "aligned")


def aligned_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial order alignments of each nation's haplotypes, degapped: the sequences themselves, in rows of one width."""
    rows = domain.view(spark, sf_dir, "haps").select(F.col("nation").alias("region_id"), F.col("seq_id").alias("row_id"), F.col("seq_id").cast("string").alias("name"), "seq")
    done = msa.aligned(rows)
    width = done.groupBy("region_id").agg((F.min(F.length("aligned")) == F.max(F.length("aligned"))).alias("even"))
    return done.join(width, "region_id").select("region_id", "row_id", F.replace("aligned", F.lit("-"), F.lit("")).alias("seq"), "even")


def pair_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs of aligning each haplotype to the one before of its nation: three pieces, of which the middle one may differ."""
    known: dict = {}
    seqs = domain.view(spark, sf_dir, "haps", known)
    q, t = (seqs.select(F.col("seq_id").alias(f"{k}_id"), F.col("seq").alias(f"{n}_seq")) for k, n in (("query", "query"), ("outer", "target")))
    done = align.align_pairs(domain.view(spark, sf_dir, "hap_pairs", known).where("outer_id is not null").join(q, "query_id").join(t, "outer_id"))
    ops = cigar.parse(F.col("cigar"))
    return done.select("query_id", "outer_id", cigar.query_span(ops).alias("q_span"), cigar.target_span(ops).alias("t_span"), (F.col("cost") <= align.most_cost(F.col("query_seq"), F.col("target_seq"))).alias("cheap"))


def fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bases 5 to 45 of each haplotype, every second one read backwards."""
    rows = domain.view(spark, sf_dir, "haps").select(F.col("seq_id").cast("string").alias("name"), "seq")
    ranges = rows.select("name", F.lit(5).alias("start"), F.lit(45).alias("end"), F.when(F.col("name").cast("long") % 2 == 0, "-").otherwise("+").alias("strand"))
    return msa.members(ranges, rows).select("name", "strand", "length", "seq")


def flipped_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps with the paths of finished orders turned round."""
    known: dict = {}
    turned = domain.view(spark, sf_dir, "orders", known).where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("path_id"))
    return msa.flipped(domain.view(spark, sf_dir, "steps", known), turned)


def n_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments cut where two or more A, which stand for N here, follow each other."""
    segments = domain.view(spark, sf_dir, "segments")
    each = segments.select("seg_id", F.explode(sequences.cut_at_n(F.translate("seq", "A", "N"), 2)).alias("p"))
    return each.select("seg_id", "p.start", "p.end")


def top_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top list: the 20 links that jump furthest."""
    known: dict = {}
    return graph.top_links(domain.view(spark, sf_dir, "segments", known), domain.view(spark, sf_dir, "links", known), 20)


def top_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top list: the 20 segments with most visits."""
    known: dict = {}
    return graph.top_depth(domain.view(spark, sf_dir, "segments", known), domain.view(spark, sf_dir, "steps", known), 20)


def top_white_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top list: the 20 widest stretches of layout that neighbouring steps jump."""
    known: dict = {}
    found = graph.gaps(domain.view(spark, sf_dir, "segments", known), domain.view(spark, sf_dir, "steps", known))
    top = graph.top_white_space(found, 20)
    return top.select("path_id", "idx", "a", "b", F.col("gap_bp").cast("long").alias("gap_bp"), "rank")


def subset_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences that a list names: one by sample and haplotype, one by sample, one with coordinates, one exactly."""
    seqs = domain.view(spark, sf_dir, "seqs")
    names = spark.createDataFrame([("AFRICA#0",), ("ASIA",), ("EUROPE#1#ROMANIA:5-90",), ("nobody#1",)], "name string")
    return projection.named_by(seqs, names)


def transitive_followed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of hits, pieces of under 60 bases not followed, none but sequences of haplotype 1 met besides targets."""
    regions, found, seqs = alignment_queries._all(spark, sf_dir)
    keep = seqs.where(F.element_at(F.split("name", "#"), 2) == "1").select("seq_id")
    return projection.transitive(regions, found, max_depth=2, min_follow=60, subset=keep).select("region_id", "depth", "query_id", "q_first", "q_last", "target_id", "t_first", "t_last")


def transitive_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of hits; what lies in the first half of a sequence isn't followed."""
    regions, found, seqs = alignment_queries._all(spark, sf_dir)
    mask = seqs.select("seq_id", F.lit(0).alias("r_start"), F.lit(500_000).alias("r_end"))
    return projection.transitive(regions, found, max_depth=2, mask=mask).select("region_id", "depth", "query_id", "q_first", "q_last", "target_id", "t_first", "t_last")


def most_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions, found, seqs = alignment_queries._all(spark, sf_dir)
    return refine.most_entities(regions, found, seqs)


def short_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = domain.view(spark, sf_dir, "aln_ends")
    return lines.select("aln_id", sequences.short_number(F.col("m1") / 8).alias("shown"))


QUERIES = {f.__name__: f for f in (
    induced_spellings, induced_segments, smoothed_spellings, crushed_spellings, pipeline_spellings, laced_spellings, laced_records, rendered_ranges, anchored_alignments, absorbed_partitions, sketched_pairs, exact_runs, unchopped_spellings, chopped_steps, graph_alignments, trim_bounds, maf_blocks, fasta_alignments, core_columns, aligned_members, pair_alignments, fetched, flipped_paths,
    n_pieces, top_links, top_depth, top_white_space, subset_names, transitive_followed, transitive_masked, most_entities, short_numbers,
)}

_L2 = """
    WITH l0 AS (SELECT h.* FROM hits h {join0}),
    nw AS (SELECT region_id, query_id AS seq_id, least(q_first, q_last) AS start, greatest(q_first, q_last) AS stop FROM l0 WHERE query_id <> target_id),
    al AS (SELECT region_id, seq_id, start, stop, 1 AS n FROM nw UNION ALL SELECT region_id, seq_id, r_start, r_end, 0 FROM regions {mask}),
    ed AS (SELECT region_id, seq_id, pos, sum(d) AS d, sum(v) AS v FROM (SELECT region_id, seq_id, start AS pos, n AS d, 1 - n AS v FROM al UNION ALL SELECT region_id, seq_id, stop, -n, n - 1 FROM al) GROUP BY ALL),
    sw AS (SELECT region_id, seq_id, pos AS start, lead(pos) OVER w AS stop, sum(d) OVER w AS d, sum(v) OVER w AS v FROM ed WINDOW w AS (PARTITION BY region_id, seq_id ORDER BY pos)),
    fr AS (SELECT region_id, seq_id, start, stop FROM sw WHERE d > 0 AND v = 0),
    ft AS (SELECT region_id, seq_id, start AS r_start, stop AS r_end FROM ({merged}) WHERE stop - start >= {least}),
    fi AS (SELECT row_number() OVER () AS region_id, region_id AS own, seq_id, r_start, r_end FROM ft),
    h1 AS (SELECT h.* FROM ({hits1}) h {join1})
    SELECT region_id, 0 AS depth, query_id, q_first, q_last, target_id, t_first, t_last FROM l0
    UNION ALL SELECT fi.own, 1, h1.query_id, q_first, q_last, target_id, t_first, t_last FROM h1 JOIN fi ON fi.region_id = h1.region_id"""
_KEPT = "JOIN seqs s ON s.seq_id = h.query_id WHERE split_part(s.name, '#', 2) = '1' OR h.query_id = h.target_id"
_RUNS = {"merged": merge_sql("fr", "region_id, seq_id", "start", "stop", 0), "hits1": hits_sql("fi")}
domain.DUCK_ONLY |= {"loci": "SELECT o.o_custkey AS region_id, s.path_id, s.idx, s.seg_id, s.orient FROM {steps} s JOIN {orders} o ON o.o_orderkey = s.path_id"}
SQL = {
    "induced_spellings": duck("SELECT seq_id AS path_id, seq AS spelling, CASE WHEN min(seq_id % 3) OVER w = max(seq_id % 3) OVER w THEN 1 ELSE 3 END AS n_steps FROM haps WINDOW w AS (PARTITION BY nation)", "haps"),
    "induced_segments": duck("""
        WITH h AS (SELECT *, min(seq_id % 3) OVER w = max(seq_id % 3) OVER w AS one FROM haps WINDOW w AS (PARTITION BY nation))
        SELECT seq, n_paths FROM (SELECT substr(seq, 1, 20) AS seq, nation, count(*) AS n_paths FROM h WHERE NOT one GROUP BY ALL UNION ALL SELECT substr(seq, 41, 20), nation, count(*) FROM h WHERE NOT one GROUP BY ALL
            UNION ALL SELECT substr(seq, 21, 20), nation, count(*) FROM h WHERE NOT one GROUP BY ALL UNION ALL SELECT seq, nation, count(*) FROM h WHERE one GROUP BY ALL)""", "haps"),
    "smoothed_spellings": duck("SELECT seq_id AS path_id, seq AS spelling FROM haps", "haps"),
    "crushed_spellings": duck("SELECT seq_id AS path_id, seq AS spelling FROM haps", "haps"),
    "pipeline_spellings": duck("SELECT path_id, spelling FROM spelt", "spelt"),
    "laced_spellings": duck("SELECT 'h' || seq_id AS path_id, seq AS spelling, CASE WHEN seq_id % 2 = 0 THEN 2 ELSE 3 END AS n_steps FROM haps", "haps"),
    "laced_records": duck("""
        WITH c AS (SELECT 'c' || query_id AS chrom, (ts % 1000 + 1 + query_id * 1000)::BIGINT AS pos, CASE WHEN strand = '-' THEN 'C' ELSE 'G' END AS alt, 's' || n_ins AS sample,
                          CASE WHEN n_x = 1 THEN 'GT:DP' ELSE 'GT' END AS fmt, CASE WHEN n_del > 3 THEN '0/1' ELSE '1/1' END || CASE WHEN n_x = 1 THEN ':' || m2 ELSE '' END AS call FROM aln_base),
        b AS (SELECT chrom, pos, alt, sample, min(struct_pack(call := call, fmt := fmt)) AS m FROM c GROUP BY ALL),
        v AS (SELECT chrom, pos, alt, bool_or(fmt = 'GT:DP') AS dp FROM c GROUP BY ALL), n AS (SELECT DISTINCT sample FROM c),
        x AS (SELECT v.*, n.sample, CASE WHEN b.m IS NULL THEN './.' ELSE split_part(b.m.call, ':', 1) END || CASE WHEN dp THEN ':' || CASE WHEN b.m.fmt = 'GT:DP' THEN split_part(b.m.call, ':', 2) ELSE '.' END ELSE '' END AS t
              FROM v CROSS JOIN n LEFT JOIN b ON b.chrom = v.chrom AND b.pos = v.pos AND b.alt = v.alt AND b.sample = n.sample)
        SELECT chrom, pos, 'A' AS ref, alt, CASE WHEN dp THEN 'GT:DP' ELSE 'GT' END AS format, string_agg(t, chr(9) ORDER BY sample) AS genotypes FROM x GROUP BY chrom, pos, alt, dp""", "aln_base"),
    "rendered_ranges": duck("SELECT path_id AS range_id, path_id, 5::BIGINT AS start, least(30, length)::BIGINT AS \"end\" FROM path_len WHERE length > 5", "path_len"),
    "anchored_alignments": duck("SELECT query_id, outer_id, 60 AS q_span, 60 AS t_span, true AS cheap FROM hap_pairs WHERE outer_id IS NOT NULL", "hap_pairs"),
    "absorbed_partitions": duck(f"""
        WITH p AS (SELECT *, lag(rank) OVER w AS lr, lag(stop) OVER w = start AS lt, lag(stop) OVER w - lag(start) OVER w AS ll, lead(rank) OVER w AS rr, lead(start) OVER w = stop AS rt, lead(stop) OVER w - lead(start) OVER w AS rl
                   FROM ({{partition_windows}}) WINDOW w AS (PARTITION BY seq_id ORDER BY start)),
        m AS (SELECT seq_id, start, stop, CASE WHEN stop - start < 500 AND lt AND ll >= 500 THEN lr WHEN stop - start < 500 AND rt AND rl >= 500 THEN rr ELSE rank END AS rank FROM p)
        SELECT seq_id, start, stop, rank FROM ({merge_sql('m', 'seq_id, rank', 'start', 'stop', 0)})""").replace("{partition_windows}", cohort_queries.SQL["partition_windows"]),
    "exact_runs": duck("SELECT query_id, outer_id AS target_id, 0 AS qs, 20 AS longest FROM hap_pairs WHERE outer_id IS NOT NULL UNION ALL SELECT query_id, middle_id, 20, 20 FROM hap_pairs WHERE middle_id IS NOT NULL", "hap_pairs"),
    "unchopped_spellings": duck("SELECT path_id, spelling FROM spelt", "spelt"),
    "chopped_steps": duck("""
        WITH e AS (SELECT s.path_id, s.idx, s.seg_id, s.orient, greatest(1, (g.len + 7) // 8) AS n FROM steps s JOIN segments g ON g.seg_id = s.seg_id),
        k AS (SELECT *, unnest(range(n)) AS k FROM e)
        SELECT path_id, row_number() OVER (PARTITION BY path_id ORDER BY idx, k) - 1 AS idx, seg_id || '.' || CASE WHEN orient = '-' THEN n - 1 - k ELSE k END AS seg_id, orient FROM k""", "steps", "segments"),
    "graph_alignments": duck("""
        WITH g AS (SELECT DISTINCT l.region_id, l.seg_id, s.seq FROM loci l JOIN segments s ON s.seg_id = l.seg_id),
        v AS (SELECT region_id, path_id, seg_id, arg_max(orient, idx) AS orient FROM loci GROUP BY ALL),
        c AS (SELECT p.region_id, p.path_id, g.seg_id, CASE WHEN v.orient IS NULL THEN repeat('-', length(g.seq)) WHEN v.orient = '-' THEN reverse(translate(g.seq, 'ACGT', 'TGCA')) ELSE g.seq END AS t
              FROM (SELECT DISTINCT region_id, path_id FROM loci) p JOIN g ON g.region_id = p.region_id LEFT JOIN v ON v.region_id = p.region_id AND v.path_id = p.path_id AND v.seg_id = g.seg_id)
        SELECT region_id, path_id, string_agg(t, '' ORDER BY seg_id) AS aligned FROM c GROUP BY region_id, path_id""", "loci", "segments"),
    "trim_bounds": duck("SELECT region_id, coalesce(min(CASE WHEN length(ltrim(aligned, '-')) > 0 THEN length(aligned) - length(ltrim(aligned, '-')) END), 0)::INT AS first, coalesce(max(CASE WHEN length(ltrim(aligned, '-')) > 0 THEN length(rtrim(aligned, '-')) END), max(length(aligned)))::INT AS last FROM msa GROUP BY region_id", "msa"),
    "maf_blocks": duck("""
        WITH t AS (SELECT *, substr(aligned, (min(length(aligned) - length(ltrim(aligned, '-'))) OVER w)::INT + 1, (max(length(rtrim(aligned, '-'))) OVER w - min(length(aligned) - length(ltrim(aligned, '-'))) OVER w)::INT) AS a FROM msa WINDOW w AS (PARTITION BY region_id))
        SELECT region_id, 'a score=0.0' || chr(10) || string_agg('s ' || name || ' ' || row_id * 10 || ' ' || length(replace(a, '-', '')) || ' + 1000 ' || a, chr(10) ORDER BY row_id) || chr(10) AS block FROM t GROUP BY region_id""", "msa"),
    "fasta_alignments": duck("""
        WITH t AS (SELECT *, substr(aligned, (min(length(aligned) - length(ltrim(aligned, '-'))) OVER w)::INT + 1, (max(length(rtrim(aligned, '-'))) OVER w - min(length(aligned) - length(ltrim(aligned, '-'))) OVER w)::INT) AS a FROM msa WINDOW w AS (PARTITION BY region_id))
        SELECT region_id, row_id, '>' || name || chr(10) || rtrim(substr(a, 1, 20) || chr(10) || substr(a, 21, 20) || chr(10) || substr(a, 41, 20), chr(10)) AS record FROM t""", "msa"),
    "core_columns": duck("""
        WITH c AS (SELECT region_id, row_id, col, base FROM (SELECT region_id, row_id, unnest(range(length(aligned))) AS col, aligned FROM msa), LATERAL (SELECT substr(aligned, (col + 1)::INT, 1) AS base)),
        k AS (SELECT *, row_number() OVER (PARTITION BY region_id, row_id ORDER BY col) AS k, count(*) OVER (PARTITION BY region_id, row_id) AS n FROM c WHERE base <> '-'),
        b AS (SELECT region_id, min(col) AS first, max(col) + 1 AS last FROM k WHERE k > 3 AND k <= n - 3 GROUP BY region_id)
        SELECT m.region_id, m.row_id, substr(m.aligned, (b.first + 1)::INT, (b.last - b.first)::INT) AS aligned FROM msa m JOIN b ON b.region_id = m.region_id""", "msa"),
    "aligned_members": duck("SELECT nation AS region_id, seq_id AS row_id, seq, true AS even FROM haps", "haps"),
    "pair_alignments": duck("SELECT query_id, outer_id, 60 AS q_span, 60 AS t_span, true AS cheap FROM hap_pairs WHERE outer_id IS NOT NULL", "hap_pairs"),
    "fetched": duck("SELECT seq_id::VARCHAR AS name, CASE WHEN seq_id % 2 = 0 THEN '-' ELSE '+' END AS strand, 60 AS length, CASE WHEN seq_id % 2 = 0 THEN reverse(translate(substr(seq, 6, 40), 'ACGT', 'TGCA')) ELSE substr(seq, 6, 40) END AS seq FROM haps", "haps"),
    "flipped_paths": duck("""
        SELECT s.path_id, CASE WHEN o.o_orderstatus = 'F' THEN max(s.idx) OVER (PARTITION BY s.path_id) - s.idx ELSE s.idx END AS idx, s.seg_id, CASE WHEN o.o_orderstatus = 'F' THEN CASE WHEN s.orient = '+' THEN '-' ELSE '+' END ELSE s.orient END AS orient
        FROM steps s JOIN orders o ON o.o_orderkey = s.path_id""", "steps"),
    "n_pieces": duck("""
        WITH b AS (SELECT seg_id, pos, substr(seq, (pos + 1)::INT, 1) = 'A' AS n FROM (SELECT seg_id, seq, unnest(range(length(seq))) AS pos FROM segments)),
        r AS (SELECT *, pos - row_number() OVER (PARTITION BY seg_id, n ORDER BY pos) AS run FROM b),
        l AS (SELECT *, count(*) OVER (PARTITION BY seg_id, n, run) AS size FROM r),
        k AS (SELECT seg_id, pos, pos - row_number() OVER (PARTITION BY seg_id ORDER BY pos) AS run FROM l WHERE NOT n OR size < 2)
        SELECT seg_id, min(pos)::INT AS start, (max(pos) + 1)::INT AS "end" FROM k GROUP BY seg_id, run""", "segments"),
    "top_links": duck("""
        WITH o AS (SELECT seg_id, row_number() OVER (ORDER BY seg_id) - 1 AS ord FROM segments),
        j AS (SELECT DISTINCT from_id, to_id, abs(a.ord - b.ord) AS jump FROM links l JOIN o a ON a.seg_id = l.from_id JOIN o b ON b.seg_id = l.to_id)
        SELECT * FROM (SELECT *, row_number() OVER (ORDER BY jump DESC, from_id, to_id) AS rank FROM j) WHERE rank <= 20""", "segments", "links"),
    "top_depth": duck("SELECT * FROM (SELECT g.seg_id, g.len, count(*) AS visits, count(DISTINCT s.path_id) AS paths, row_number() OVER (ORDER BY count(*) DESC, g.seg_id) AS rank FROM segments g JOIN steps s ON s.seg_id = g.seg_id GROUP BY g.seg_id, g.len) WHERE rank <= 20", "segments", "steps"),
    "top_white_space": duck("""
        WITH o AS (SELECT seg_id, sum(len) OVER (ORDER BY seg_id) - len AS a, sum(len) OVER (ORDER BY seg_id) AS z FROM segments),
        n AS (SELECT path_id, idx, seg_id AS a, lead(seg_id) OVER (PARTITION BY path_id ORDER BY idx) AS b FROM steps),
        g AS (SELECT n.path_id, n.idx, n.a, n.b, CASE WHEN x.z <= y.a THEN y.a - x.z WHEN y.z <= x.a THEN x.a - y.z ELSE 0 END::BIGINT AS gap_bp FROM n JOIN o x ON x.seg_id = n.a JOIN o y ON y.seg_id = n.b)
        SELECT * FROM (SELECT *, row_number() OVER (ORDER BY gap_bp DESC, path_id, idx) AS rank FROM g) WHERE rank <= 20""", "segments", "steps"),
    "subset_names": duck("SELECT seq_id FROM seqs WHERE name LIKE 'AFRICA#0%' OR name LIKE 'ASIA#%' OR name = 'EUROPE#1#ROMANIA' OR name LIKE 'EUROPE#1#%'", "seqs"),
    "transitive_followed": duck(_L2.format(join0=_KEPT, join1=_KEPT, mask="", least=60, **_RUNS), "hits", "regions", "ent", "eops", "seqs"),
    "transitive_masked": duck(_L2.format(join0="", join1="", mask="UNION ALL SELECT DISTINCT region_id, seq_id, 0, 500000, 0 FROM nw", least=0, **_RUNS), "hits", "regions", "ent", "eops"),
    "most_entities": duck("""
        WITH e AS (SELECT seq_id, split_part(name, '#', 1) || '#' || split_part(name, '#', 2) AS entity FROM seqs),
        p AS (SELECT DISTINCT n.target_id, q.entity FROM ent n JOIN e q ON q.seq_id = n.query_id JOIN e t ON t.seq_id = n.target_id WHERE q.entity <> t.entity)
        SELECT r.region_id, (SELECT count(*) FROM p WHERE p.target_id = r.seq_id) AS most FROM regions r""", "ent", "seqs", "regions"),
    "short_numbers": duck("SELECT aln_id, rtrim(rtrim(format('{:.7f}', m1 / 8), '0'), '.') AS shown FROM aln_ends", "aln_ends"),
}
