"""Queries over variation graphs, coverage, genotypes and similarity, and what DuckDB must get."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions import sequences
from loomspan.operators import genotype, graph, similarity
from loomspan.plans import domain
from loomspan.plans.domain import duck


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    known: dict = {}
    return tuple(domain.view(spark, sf_dir, n, known) for n in ("segments", "links", "steps"))


def graph_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.metrics(*_graph(spark, sf_dir))
    return found.select("metric", F.round("value", 6).alias("value"))


def graph_node_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments, _, steps = _graph(spark, sf_dir)
    return graph.node_coverage(segments, steps)


def graph_coverage_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments, _, steps = _graph(spark, sf_dir)
    return graph.coverage_histogram(graph.node_coverage(segments, steps))


def graph_path_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments, _, steps = _graph(spark, sf_dir)
    return graph.path_positions(segments, steps)


def graph_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments, _, steps = _graph(spark, sf_dir)
    return graph.spellings(segments, steps)


def graph_path_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments, _, steps = _graph(spark, sf_dir)
    return graph.gaps(segments, steps).select("path_id", "idx", "a", "b", F.col("jump").cast("long").alias("jump"), F.col("gap_bp").cast("long").alias("gap_bp"))


def graph_top_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top list: the 20 widest jumps over the layout."""
    segments, _, steps = _graph(spark, sf_dir)
    found = graph.gaps(segments, steps).select("path_id", "idx", "a", "b", F.col("gap_bp").cast("long").alias("gap_bp"), F.col("jump").cast("long").alias("jump"))
    return found.orderBy(F.desc("gap_bp"), F.desc("jump"), "path_id", "idx").limit(20)


def graph_white_space_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments, _, steps = _graph(spark, sf_dir)
    return graph.white_space_regions(graph.gaps(segments, steps), 1000, 2).select(F.col("start_bp").cast("long").alias("start_bp"), F.col("end_bp").cast("long").alias("end_bp"), "crossing")


def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments, links, _ = _graph(spark, sf_dir)
    return graph.components(segments, links)


def graph_tips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loose ends of the graph of customers' orders."""
    known: dict = {}
    return graph.tips(*(domain.view(spark, sf_dir, n, known) for n in ("visit_segments", "visit_links", "visit_steps")))


def graph_repeat_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations that nearly all their customers leave in one way."""
    return graph.repeat_contexts(domain.view(spark, sf_dir, "tour_steps"))


def graph_repeat_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, steps = _graph(spark, sf_dir)
    return graph.repeat_runs(steps)


def graph_self_loops_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings after run nodes replaced loops: they must be those before."""
    segments, links, steps = _graph(spark, sf_dir)
    new_segments, _, new_steps = graph.normalize_self_loops(segments, links, steps)
    return graph.spellings(new_segments, new_steps)


def graph_depth_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments, _, steps = _graph(spark, sf_dir)
    return graph.depth_runs(segments, steps, 0.6, 0.001)


def graph_sparse_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments, _, steps = _graph(spark, sf_dir)
    return graph.sparse_runs(segments, steps, 0.0015)


def graph_chop(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments, _, _ = _graph(spark, sf_dir)
    return graph.chop(segments, 16)


def graph_linear_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments, links, _ = _graph(spark, sf_dir)
    return graph.linear_chains(links, segments)


def graph_bubbles(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, links, _ = _graph(spark, sf_dir)
    return graph.simple_bubbles(links)


def path_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name functions on sequence names."""
    seqs = domain.view(spark, sf_dir, "seqs")
    named = seqs.select("seq_id", sequences.pansn(F.col("name")).alias("p"), sequences.sample_and_haplotype(F.col("name")).alias("s"), sequences.group_name(F.col("name"), "#", 2).alias("grp"), sequences.region(F.concat("name", F.lit(":"), "seq_id", F.lit("-"), "length")).alias("r"))
    return named.select("seq_id", "p.sample", "p.hap", "p.contig", F.col("s.sample").alias("sample2"), F.col("s.hap").alias("hap2"), "grp", F.col("r.start").alias("r_start"), F.col("r.end").alias("r_end"))


def reverse_complements(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = domain.view(spark, sf_dir, "segments")
    return segments.select("seg_id", sequences.reverse_complement(F.col("seq")).alias("rc"))


def n_clipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments between runs of N: ``A`` stands for N here, runs of one or more count."""
    segments = domain.view(spark, sf_dir, "segments").withColumn("clip", sequences.n_clip(F.translate("seq", "A", "N"), 1))
    return segments.where("clip is not null").select("seg_id", F.col("clip.from").alias("c_from"), F.col("clip.to").alias("c_to"))


def pack_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits of the walks between a tenth and nine tenths of their length, counted by segment."""
    segments, _, steps = _graph(spark, sf_dir)
    lens = steps.join(segments.select("seg_id", "len"), "seg_id")
    reads = lens.groupBy(F.col("path_id").alias("read_id")).agg(F.sum("len").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("idx", "seg_id", "orient"))), lambda s: F.struct(s["seg_id"].alias("seg_id"), s["orient"].alias("orient"))).alias("walk"))
    placed = reads.select("read_id", F.expr("n div 10").alias("path_start"), F.expr("n - n div 10").alias("path_end"), "walk")
    return genotype.pack_counts(genotype.project_walks(placed, segments))


def _locus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    known: dict = {}
    return domain.view(spark, sf_dir, "cand_features", known), domain.view(spark, sf_dir, "pack", known).withColumnsRenamed({"sample_id": "locus_id", "node_id": "feature_id"})


def candidate_cosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = genotype.candidate_cosines(*_locus(spark, sf_dir))
    return found.select("locus_id", "cand_id", F.col("dot").cast("long").alias("dot"), F.col("h2").cast("long").alias("h2"), F.round("similarity", 9).alias("similarity"))


def genotype_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best pair of candidates of every locus."""
    found = genotype.cosine_genotypes(*_locus(spark, sf_dir), ploidy=2, best=1)
    return found.select("locus_id", "c1", "c2", F.col("dot").cast("long").alias("dot"), F.round("similarity", 9).alias("similarity"))


def genotype_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best triple of each locus's four nearest candidates."""
    found = genotype.cosine_genotypes(*_locus(spark, sf_dir), ploidy=3, top_k=4, best=1)
    return found.select("locus_id", "c1", "c2", "c3", F.col("dot").cast("long").alias("dot"), F.round("similarity", 9).alias("similarity"))


def infer_mosaics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as candidates, quarters of the line numbers as loci."""
    known: dict = {}
    steps, orders = domain.view(spark, sf_dir, "steps", known), domain.view(spark, sf_dir, "orders", known)
    calls = steps.join(orders, steps["path_id"] == orders["o_orderkey"]).groupBy(F.col("o_custkey").alias("sample_id"), F.expr("idx div 2").alias("locus"), F.col("path_id").alias("cand_id")).agg(F.sum(F.col("seg_id") % 50).cast("double").alias("qv"))
    return genotype.stitch_mosaics(calls, 20.0, beam=64)


def lis_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many steps of each path go up the layout in order."""
    _, _, steps = _graph(spark, sf_dir)
    walks = steps.groupBy("path_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "seg_id"))), lambda s: s["seg_id"].cast("bigint")).alias("v"))
    return walks.select("path_id", genotype.longest_increasing(F.col("v")).alias("lis"))


def similarity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = similarity.similarities(domain.view(spark, sf_dir, "msa"))
    return _rounded(found)


def similarity_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(similarity.similarities(domain.view(spark, sf_dir, "msa"), "#", 1))


def _rounded(found: DataFrame) -> DataFrame:
    return found.select("region_id", "group_a", "group_b", F.col("len_a").cast("long").alias("len_a"), F.col("len_b").cast("long").alias("len_b"), F.col("shared").cast("long").alias("shared"), *(F.round(F.col(c).cast("double"), 5).alias(c) for c in ("jaccard", "cosine", "dice", "identity")))


def ordination_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classical scaling and turned axes; eigenvectors, so rows only."""
    return similarity.polarized(similarity.ordination(similarity.similarities(domain.view(spark, sf_dir, "msa"))))


QUERIES = {f.__name__: f for f in (
    graph_metrics, graph_node_coverage, graph_coverage_histogram, graph_path_positions, graph_spellings, graph_path_jumps, graph_top_jumps, graph_white_space_regions, graph_components, graph_tips,
    graph_repeat_contexts, graph_repeat_runs, graph_self_loops_normalized, graph_depth_runs, graph_sparse_runs, graph_chop, graph_linear_chains, graph_bubbles, path_names, reverse_complements, n_clipped,
    pack_counts, candidate_cosines, genotype_cosine, genotype_topk, infer_mosaics, lis_lengths, similarity_pairs, similarity_groups, ordination_axes,
)}

domain.DUCK_ONLY |= {
    "laid": "SELECT seg_id, len, seq, row_number() OVER (ORDER BY seg_id) - 1 AS ord, coalesce(sum(len) OVER (ORDER BY seg_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS bp FROM {segments}",
    "pairs": "SELECT * FROM (SELECT path_id, idx, seg_id AS a, orient AS ao, lead(seg_id) OVER w AS b, lead(orient) OVER w AS bo FROM {steps} WINDOW w AS (PARTITION BY path_id ORDER BY idx)) WHERE b IS NOT NULL",
    "jumps": """SELECT p.path_id, p.idx, p.a, p.b, abs(x.ord - y.ord)::BIGINT AS jump,
        CASE WHEN x.bp + x.len <= y.bp THEN y.bp - x.bp - x.len WHEN y.bp + y.len <= x.bp THEN x.bp - y.bp - y.len ELSE 0 END::BIGINT AS gap_bp,
        CASE WHEN x.bp + x.len <= y.bp THEN x.bp + x.len WHEN y.bp + y.len <= x.bp THEN y.bp + y.len ELSE least(x.bp, y.bp) END AS gap_start,
        CASE WHEN x.bp + x.len <= y.bp THEN y.bp WHEN y.bp + y.len <= x.bp THEN x.bp ELSE greatest(x.bp + x.len, y.bp + y.len) END AS gap_end
        FROM {pairs} p JOIN {laid} x ON x.seg_id = p.a JOIN {laid} y ON y.seg_id = p.b""",
    "cov": """SELECT g.seg_id, g.len, coalesce(v.visits, 0)::BIGINT AS visits, coalesce(v.paths, 0)::BIGINT AS paths, coalesce(v.most, 0)::BIGINT AS most
        FROM {segments} g LEFT JOIN (SELECT seg_id, sum(n) AS visits, count(*) AS paths, max(n) AS most FROM (SELECT seg_id, path_id, count(*) AS n FROM {steps} GROUP BY ALL) GROUP BY seg_id) v ON v.seg_id = g.seg_id""",
    "spelt": "SELECT s.path_id, string_agg(CASE WHEN s.orient = '-' THEN reverse(translate(g.seq, 'ACGT', 'TGCA')) ELSE g.seq END, '' ORDER BY s.idx) AS spelling FROM {steps} s JOIN {segments} g ON g.seg_id = s.seg_id GROUP BY s.path_id",
    "runs": """SELECT path_id, seg_id, orient, min(idx) AS start_idx, count(*) AS run FROM (SELECT *, idx - row_number() OVER (PARTITION BY path_id, seg_id, orient ORDER BY idx) AS k FROM {steps}) GROUP BY path_id, seg_id, orient, k HAVING count(*) > 1""",
    "comps": """WITH RECURSIVE e AS (SELECT from_id AS a, to_id AS b FROM {links} UNION SELECT to_id, from_id FROM {links}),
        c(seg_id, comp) USING KEY (seg_id) AS (SELECT seg_id, seg_id FROM {segments} UNION
            SELECT e.b, min(c.comp) FROM c JOIN e ON e.a = c.seg_id JOIN recurring.c AS r ON r.seg_id = e.b WHERE c.comp < r.comp GROUP BY e.b) SELECT seg_id, comp FROM c""",
    "cells": "SELECT region_id, name, i AS col, aligned[i] AS base FROM (SELECT region_id, name, aligned, unnest(generate_series(1, length(aligned))) AS i FROM {msa}) WHERE aligned[i] <> '-'",
}


domain.DUCK_ONLY |= {
    "dots": """SELECT c.locus_id, c.cand_id, sum(c.weight * coalesce(p.cnt, 0))::BIGINT AS dot, sum(c.weight * c.weight)::BIGINT AS h2, any_value(x.x2) AS x2
        FROM {cand_features} c LEFT JOIN {pack} p ON p.sample_id = c.locus_id AND p.node_id = c.feature_id
        JOIN (SELECT locus_id, sum(cnt * cnt) AS x2 FROM (SELECT DISTINCT locus_id, feature_id FROM {cand_features}) f JOIN {pack} q ON q.sample_id = f.locus_id AND q.node_id = f.feature_id GROUP BY locus_id) x ON x.locus_id = c.locus_id
        GROUP BY c.locus_id, c.cand_id""",
}


def _similarity(group: str) -> str:
    return duck(f"""
        WITH c AS (SELECT region_id, col, {group} AS grp, base, count(*) AS n FROM cells GROUP BY ALL),
        z AS (SELECT region_id, grp, sum(n) AS len FROM c GROUP BY ALL), h AS (SELECT region_id, col, grp, sum(n) AS held FROM c GROUP BY ALL),
        m AS (SELECT a.region_id, a.col, a.grp AS ga, b.grp AS gb, sum(a.n * b.n) AS pairs FROM c a JOIN c b ON a.region_id = b.region_id AND a.col = b.col AND a.base = b.base AND a.grp <= b.grp GROUP BY ALL),
        s AS (SELECT m.region_id, ga, gb, sum(least(pairs, x.held, y.held)) AS shared FROM m JOIN h x ON x.region_id = m.region_id AND x.col = m.col AND x.grp = ga JOIN h y ON y.region_id = m.region_id AND y.col = m.col AND y.grp = gb GROUP BY ALL),
        r AS (SELECT s.region_id, ga AS group_a, gb AS group_b, x.len::BIGINT AS len_a, y.len::BIGINT AS len_b, shared::BIGINT AS shared, shared / (x.len + y.len - shared) AS j FROM s JOIN z x ON x.region_id = s.region_id AND x.grp = ga JOIN z y ON y.region_id = s.region_id AND y.grp = gb)
        SELECT region_id, group_a, group_b, len_a, len_b, shared, round(j::FLOAT::DOUBLE, 5) AS jaccard, round((shared / (sqrt(len_a) * sqrt(len_b)))::FLOAT::DOUBLE, 5) AS cosine,
               round((2 * shared / (len_a + len_b))::FLOAT::DOUBLE, 5) AS dice, round((2 * j / (1 + j))::FLOAT::DOUBLE, 5) AS "identity" FROM r""", "cells")


SQL = {
    "graph_metrics": duck("""
        WITH n AS (SELECT count(DISTINCT path_id) AS p FROM steps), h AS (SELECT greatest(2, ceil(p * 0.5)) AS high FROM n),
        e AS (SELECT DISTINCT seg_id FROM (SELECT seg_id, row_number() OVER (PARTITION BY path_id ORDER BY idx) AS f, row_number() OVER (PARTITION BY path_id ORDER BY idx DESC) AS l FROM steps) WHERE f = 1 OR l = 1),
        t AS (SELECT g.seg_id, e.seg_id IS NULL AS internal FROM segments g LEFT JOIN (SELECT s, count(*) AS d FROM (SELECT from_id AS s FROM links UNION ALL SELECT to_id FROM links) GROUP BY s) x ON x.s = g.seg_id LEFT JOIN e ON e.seg_id = g.seg_id WHERE coalesce(x.d, 0) <= 1),
        d AS (SELECT count(*) AS n FROM segments GROUP BY seq),
        m AS (UNPIVOT (SELECT count(*)::DOUBLE AS segments, sum(len)::DOUBLE AS total_segment_bp, sum(visits)::DOUBLE AS node_path_step_visits, avg(visits) AS node_coverage_mean, (sum(visits * len) / sum(len))::DOUBLE AS node_coverage_bp_weighted_mean,
                   quantile_disc(visits, 0.1)::DOUBLE AS node_coverage_p10, quantile_disc(visits, 0.5)::DOUBLE AS node_coverage_median, quantile_disc(visits, 0.9)::DOUBLE AS node_coverage_p90,
                   count(*) FILTER (visits = 1)::DOUBLE AS singleton_nodes, coalesce(sum(len) FILTER (visits = 1), 0)::DOUBLE AS singleton_bp, count(*) FILTER (visits >= (SELECT high FROM h))::DOUBLE AS high_coverage_nodes,
                   coalesce(sum(len) FILTER (visits >= (SELECT high FROM h)), 0)::DOUBLE AS high_coverage_bp, (sum(len * paths) / (sum(len) * (SELECT p FROM n)))::DOUBLE AS segment_occupancy_bp_fraction,
                   (sum(len) * (SELECT p FROM n) - sum(len * paths))::DOUBLE AS segment_white_space_bp_total, coalesce(sum(len) FILTER (paths / (SELECT p FROM n) <= 0.1), 0)::DOUBLE AS sparse_coverage_segment_bp,
                   min(visits)::DOUBLE AS path_depth_min, quantile_disc(visits, 0.95)::DOUBLE AS path_depth_p95, max(visits)::DOUBLE AS path_depth_max, count(*) FILTER (visits > (SELECT p FROM n))::DOUBLE AS reused_nodes FROM cov) ON COLUMNS(*) INTO NAME metric VALUE value),
        g AS (UNPIVOT (SELECT quantile_disc(jump, 0.95)::DOUBLE AS path_jump_p95, quantile_disc(jump, 0.99)::DOUBLE AS path_jump_p99, max(jump)::DOUBLE AS path_jump_max, quantile_disc(gap_bp, 0.95)::DOUBLE AS path_white_space_bp_p95,
                   quantile_disc(gap_bp, 0.99)::DOUBLE AS path_white_space_bp_p99, max(gap_bp)::DOUBLE AS path_white_space_bp_max, sum(gap_bp)::DOUBLE AS path_white_space_bp_total, avg(gap_bp)::DOUBLE AS path_white_space_bp_mean,
                   count(*) FILTER (gap_bp > 0)::DOUBLE AS path_white_space_bridges, count(*) FILTER (gap_bp >= 1000)::DOUBLE AS path_white_space_bridges_ge_threshold FROM jumps) ON COLUMNS(*) INTO NAME metric VALUE value)
        SELECT metric, round(value, 6) AS value FROM m UNION ALL SELECT metric, round(value, 6) FROM g
        UNION ALL SELECT 'duplicate_sequence_groups', count(*) FILTER (n > 1) FROM d UNION ALL SELECT 'duplicate_sequence_nodes', coalesce(sum(n) FILTER (n > 1), 0) FROM d UNION ALL SELECT 'max_duplicate_count', max(n) FROM d
        UNION ALL SELECT 'links', count(*) FROM links UNION ALL SELECT 'direct_self_loop_edges', count(*) FILTER (from_id = to_id) FROM links UNION ALL SELECT 'direct_self_loop_nodes', count(DISTINCT from_id) FILTER (from_id = to_id) FROM links
        UNION ALL SELECT 'adjacent_same_node_path_steps', count(*) FILTER (a = b) FROM pairs UNION ALL SELECT 'adjacent_same_step_path_steps', count(*) FILTER (a = b AND ao = bo) FROM pairs
        UNION ALL SELECT 'path_steps', count(*) FROM steps UNION ALL SELECT 'paths', p FROM n
        UNION ALL SELECT 'components', count(DISTINCT comp) FROM comps UNION ALL SELECT 'largest_component_nodes', max(n) FROM (SELECT count(*) AS n FROM comps GROUP BY comp)
        UNION ALL SELECT 'tips', count(*) FROM t UNION ALL SELECT 'internal_tips', count(*) FILTER (internal) FROM t
        UNION ALL SELECT 'self_loop_repeat_runs', count(*) FROM runs UNION ALL SELECT 'self_loop_max_repeat_run_len', coalesce(max(run), 0) FROM runs""", "cov", "jumps", "links", "pairs", "steps", "runs", "comps"),
    "graph_node_coverage": duck("SELECT * FROM cov", "cov"),
    "graph_coverage_histogram": duck("""SELECT CASE WHEN visits <= 2 THEN visits::VARCHAR WHEN visits <= 4 THEN '3-4' WHEN visits <= 8 THEN '5-8' WHEN visits <= 16 THEN '9-16' WHEN visits <= 32 THEN '17-32' WHEN visits <= 64 THEN '33-64' WHEN visits <= 128 THEN '65-128' ELSE '129+' END AS bucket,
        count(*) AS nodes, sum(len)::BIGINT AS bp FROM cov GROUP BY 1""", "cov"),
    "graph_path_positions": duck('SELECT path_id, idx, s.seg_id, orient, (sum(len) OVER w - len)::BIGINT AS start, (sum(len) OVER w)::BIGINT AS "end" FROM steps s JOIN segments g ON g.seg_id = s.seg_id WINDOW w AS (PARTITION BY path_id ORDER BY idx)', "steps", "segments"),
    "graph_spellings": duck("SELECT * FROM spelt", "spelt"),
    "graph_self_loops_normalized": duck("SELECT * FROM spelt", "spelt"),
    "graph_path_jumps": duck("SELECT path_id, idx, a, b, jump, gap_bp FROM jumps", "jumps"),
    "graph_top_jumps": duck("SELECT path_id, idx, a, b, gap_bp, jump FROM jumps ORDER BY gap_bp DESC, jump DESC, path_id, idx LIMIT 20", "jumps"),
    "graph_white_space_regions": duck("""
        WITH e AS (SELECT pos, sum(d) AS d FROM (SELECT gap_start AS pos, 1 AS d FROM jumps WHERE gap_bp >= 1000 AND gap_start < gap_end UNION ALL SELECT gap_end, -1 FROM jumps WHERE gap_bp >= 1000 AND gap_start < gap_end) GROUP BY pos),
        r AS (SELECT pos AS start_bp, lead(pos) OVER (ORDER BY pos) AS end_bp, sum(d) OVER (ORDER BY pos) AS crossing FROM e)
        SELECT start_bp::BIGINT AS start_bp, end_bp::BIGINT AS end_bp, crossing::BIGINT AS crossing FROM r WHERE end_bp IS NOT NULL AND crossing >= 2""", "jumps"),
    "graph_components": duck("SELECT seg_id, comp FROM comps", "comps"),
    "graph_tips": duck("""
        WITH e AS (SELECT DISTINCT seg_id FROM (SELECT seg_id, row_number() OVER (PARTITION BY path_id ORDER BY idx) AS f, row_number() OVER (PARTITION BY path_id ORDER BY idx DESC) AS l FROM visit_steps) WHERE f = 1 OR l = 1)
        SELECT g.seg_id, e.seg_id IS NULL AS internal FROM visit_segments g LEFT JOIN (SELECT s, count(*) AS d FROM (SELECT from_id AS s FROM visit_links UNION ALL SELECT to_id FROM visit_links) GROUP BY s) x ON x.s = g.seg_id LEFT JOIN e ON e.seg_id = g.seg_id WHERE coalesce(x.d, 0) <= 1""", "visit_segments", "visit_links", "visit_steps"),
    "graph_repeat_contexts": duck("""
        WITH c AS (SELECT concat(seg_id, orient) AS node, coalesce(concat(lag(seg_id) OVER w, lag(orient) OVER w), '') AS l, coalesce(concat(lead(seg_id) OVER w, lead(orient) OVER w), '') AS r FROM tour_steps WINDOW w AS (PARTITION BY path_id ORDER BY idx)),
        n AS (SELECT node, CASE WHEN l = '' THEN '^' ELSE l END AS l, CASE WHEN r = '' THEN '$' ELSE r END AS r, count(*) AS n FROM c GROUP BY ALL),
        k AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY n DESC, l, r) AS rank FROM n),
        t AS (SELECT node, sum(n)::BIGINT AS total, max(n) FILTER (rank = 1) AS dominant, max(n) FILTER (rank = 2) AS second, max(l) FILTER (rank = 1) AS dominant_left, max(r) FILTER (rank = 1) AS dominant_right FROM k GROUP BY node)
        SELECT node, total, dominant, total - dominant AS minor, dominant_left, dominant_right FROM t WHERE second < dominant AND total - dominant <= 2 AND dominant / total >= 0.8""", "tour_steps"),
    "graph_repeat_runs": duck("SELECT * FROM runs", "runs"),
    "graph_depth_runs": duck("""
        WITH v AS (SELECT l.ord, c.visits, c.len FROM laid l JOIN cov c ON c.seg_id = l.seg_id), k AS (SELECT *, ord - row_number() OVER (ORDER BY ord) AS i FROM v WHERE visits >= (SELECT greatest(ceil(max(visits) * 60 / 100), floor((SELECT count(DISTINCT path_id) FROM steps) * 0.001), 2) FROM v))
        SELECT min(ord) AS start_order, max(ord) AS end_order, count(*) AS nodes, min(visits) AS min_depth, max(visits) AS max_depth, sum(visits)::BIGINT AS sum_depth FROM k GROUP BY i""", "laid", "cov", "steps"),
    "graph_sparse_runs": duck("""
        WITH n AS (SELECT count(DISTINCT path_id) AS p FROM steps), v AS (SELECT l.ord, c.paths, c.len FROM laid l JOIN cov c ON c.seg_id = l.seg_id), k AS (SELECT *, ord - row_number() OVER (ORDER BY ord) AS i FROM v WHERE paths / (SELECT p FROM n) <= 0.0015)
        SELECT min(ord) AS start_order, max(ord) AS end_order, count(*) AS nodes, sum(len)::BIGINT AS bp, sum(len * ((SELECT p FROM n) - paths))::BIGINT AS missing_path_bp FROM k GROUP BY i""", "laid", "cov", "steps"),
    "graph_chop": duck("SELECT seg_id, p::INT AS piece, least(16, len - p * 16)::INT AS len, substr(seq, (p * 16 + 1)::BIGINT, 16) AS seq FROM (SELECT *, unnest(range(greatest(1, ceil(len / 16)::INT))) AS p FROM segments)", "segments"),
    "graph_linear_chains": duck("""
        WITH RECURSIVE o AS (SELECT s, side, count(*) AS n FROM (SELECT from_id AS s, CASE WHEN from_orient = '+' THEN 'out' ELSE 'in' END AS side FROM links UNION ALL SELECT to_id, CASE WHEN to_orient = '+' THEN 'in' ELSE 'out' END FROM links) GROUP BY ALL),
        u AS (SELECT DISTINCT from_id AS a, to_id AS b FROM links l JOIN o x ON x.s = from_id AND x.side = 'out' AND x.n = 1 JOIN o y ON y.s = to_id AND y.side = 'in' AND y.n = 1 WHERE from_orient = '+' AND to_orient = '+' AND from_id <> to_id),
        e AS (SELECT a, b FROM u UNION SELECT b, a FROM u), r AS (SELECT seg_id AS v, seg_id AS w FROM segments UNION SELECT r.v, e.b FROM r JOIN e ON e.a = r.w)
        SELECT v AS seg_id, min(w) AS chain FROM r GROUP BY v""", "links", "segments"),
    "graph_bubbles": duck("""
        WITH e AS (SELECT DISTINCT concat(from_id, from_orient) AS f, concat(to_id, to_orient) AS t FROM links),
        b AS (SELECT x.f AS source, y.t AS sink, count(DISTINCT x.t) AS branches FROM e x JOIN e y ON x.t = y.f WHERE x.f <> y.t AND x.f <> x.t AND x.t <> y.t GROUP BY ALL)
        SELECT source, sink, branches, (d.f IS NOT NULL)::INT AS direct FROM b LEFT JOIN e d ON d.f = source AND d.t = sink WHERE branches + (d.f IS NOT NULL)::INT >= 2""", "links"),
    "path_names": duck("SELECT seq_id, split_part(name, '#', 1) AS sample, split_part(name, '#', 2) AS hap, split_part(name, '#', 3) AS contig, split_part(name, '#', 1) AS sample2, split_part(name, '#', 2) AS hap2, split_part(name, '#', 1) || '#' || split_part(name, '#', 2) AS grp, seq_id AS r_start, length AS r_end FROM seqs", "seqs"),
    "reverse_complements": duck("SELECT seg_id, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc FROM segments", "segments"),
    "n_clipped": duck("SELECT seg_id, (length(seq) - length(ltrim(seq, 'A')))::INT AS c_from, length(rtrim(seq, 'A'))::INT AS c_to FROM segments WHERE length(replace(seq, 'A', '')) > 0", "segments"),
    "pack_counts": duck("""
        WITH p AS (SELECT s.path_id, s.seg_id, sum(len) OVER (PARTITION BY path_id ORDER BY idx) AS z, len, sum(len) OVER (PARTITION BY path_id) AS n FROM steps s JOIN segments g ON g.seg_id = s.seg_id)
        SELECT seg_id AS node_id, count(*) AS cnt FROM p WHERE z - len < n - n // 10 AND z > n // 10 GROUP BY seg_id""", "steps", "segments"),
    "candidate_cosines": duck("SELECT locus_id, cand_id, dot, h2, round(dot / (sqrt(h2) * sqrt(x2)), 9) AS similarity FROM dots", "dots"),
    "genotype_cosine": duck("""
        WITH g AS (SELECT a.locus_id, a.cand_id AS i, b.cand_id AS j, sum(a.weight * b.weight) AS h FROM cand_features a JOIN cand_features b ON a.locus_id = b.locus_id AND a.feature_id = b.feature_id AND a.cand_id < b.cand_id GROUP BY ALL),
        c AS (SELECT a.locus_id, a.cand_id AS c1, b.cand_id AS c2, (a.dot + b.dot)::BIGINT AS dot, a.h2 + b.h2 + 2 * CASE WHEN a.cand_id = b.cand_id THEN a.h2 ELSE coalesce(g.h, 0) END AS g2, a.x2
              FROM dots a JOIN dots b ON a.locus_id = b.locus_id AND a.cand_id <= b.cand_id LEFT JOIN g ON g.locus_id = a.locus_id AND g.i = a.cand_id AND g.j = b.cand_id),
        r AS (SELECT *, least(1.0, dot / (sqrt(g2) * sqrt(x2))) AS s FROM c)
        SELECT locus_id, c1, c2, dot, round(s, 9) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY locus_id ORDER BY round(s, 12) DESC, dot DESC, c1, c2) AS rank FROM r) WHERE rank = 1""", "dots", "cand_features"),
    "genotype_topk": duck("""
        WITH t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY locus_id ORDER BY least(1.0, dot / (sqrt(h2) * sqrt(x2))) DESC, dot DESC, cand_id) AS k FROM dots) WHERE k <= 4),
        f AS (SELECT c.* FROM cand_features c JOIN t ON t.locus_id = c.locus_id AND t.cand_id = c.cand_id),
        g AS (SELECT a.locus_id, a.cand_id AS i, b.cand_id AS j, sum(a.weight * b.weight) AS h FROM f a JOIN f b ON a.locus_id = b.locus_id AND a.feature_id = b.feature_id AND a.cand_id <= b.cand_id GROUP BY ALL),
        c AS (SELECT a.locus_id, a.cand_id AS c1, b.cand_id AS c2, d.cand_id AS c3, (a.dot + b.dot + d.dot)::BIGINT AS dot, a.x2,
                     a.h2 + b.h2 + d.h2 + 2 * (coalesce(x.h, 0) + coalesce(y.h, 0) + coalesce(z.h, 0)) AS g2
              FROM t a JOIN t b ON b.locus_id = a.locus_id AND b.cand_id >= a.cand_id JOIN t d ON d.locus_id = a.locus_id AND d.cand_id >= b.cand_id
              LEFT JOIN g x ON x.locus_id = a.locus_id AND x.i = a.cand_id AND x.j = b.cand_id LEFT JOIN g y ON y.locus_id = a.locus_id AND y.i = a.cand_id AND y.j = d.cand_id LEFT JOIN g z ON z.locus_id = a.locus_id AND z.i = b.cand_id AND z.j = d.cand_id),
        s AS (SELECT *, least(1.0, dot / (sqrt(g2) * sqrt(x2))) AS s FROM c)
        SELECT locus_id, c1, c2, c3, dot, round(s, 9) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY locus_id ORDER BY round(s, 12) DESC, dot DESC, c1, c2, c3) AS rank FROM s) WHERE rank = 1""", "dots", "cand_features"),
    "infer_mosaics": duck("""
        WITH RECURSIVE q AS (SELECT o.o_custkey AS sample_id, s.idx // 2 AS locus, s.path_id AS cand_id, sum(s.seg_id % 50)::DOUBLE AS qv FROM steps s JOIN orders o ON o.o_orderkey = s.path_id GROUP BY ALL),
        n AS (SELECT *, dense_rank() OVER (PARTITION BY sample_id ORDER BY locus) AS k FROM q),
        v AS (SELECT sample_id, k, cand_id, qv AS score, [cand_id] AS path FROM n WHERE k = 1
              UNION ALL SELECT sample_id, k, cand_id, score, path FROM (
                  SELECT n.sample_id, n.k, n.cand_id, v.score + n.qv - CASE WHEN v.cand_id <> n.cand_id THEN 20 ELSE 0 END AS score, list_append(v.path, n.cand_id) AS path,
                         row_number() OVER (PARTITION BY n.sample_id, n.cand_id ORDER BY v.score + n.qv - CASE WHEN v.cand_id <> n.cand_id THEN 20 ELSE 0 END DESC, v.path) AS rank
                  FROM v JOIN n ON n.sample_id = v.sample_id AND n.k = v.k + 1) WHERE rank = 1),
        b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY k DESC, score DESC, path) AS rank FROM v) WHERE rank = 1),
        p AS (SELECT sample_id, score, unnest(range(1, len(path) + 1)) AS k, unnest(path) AS cand_id FROM b)
        SELECT DISTINCT p.sample_id, n.locus, p.cand_id, p.score FROM p JOIN n ON n.sample_id = p.sample_id AND n.k = p.k""", "steps"),
    "lis_lengths": duck("""
        WITH RECURSIVE c AS (SELECT path_id, idx, seg_id, 1 AS n FROM steps UNION SELECT c.path_id, s.idx, s.seg_id, c.n + 1 FROM c JOIN steps s ON s.path_id = c.path_id AND s.idx > c.idx AND s.seg_id > c.seg_id)
        SELECT path_id, max(n)::INT AS lis FROM c GROUP BY path_id""", "steps"),
    "similarity_pairs": _similarity("name"),
    "similarity_groups": _similarity("split_part(name, '#', 1)"),
}
