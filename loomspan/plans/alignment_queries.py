"""Queries over alignments and intervals, and what DuckDB must get."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.operators import cigar, intervals, projection, refine
from loomspan.plans import domain
from loomspan.plans.domain import duck


def alignments(spark: SparkSession, sf_dir: str, known: dict | None = None) -> DataFrame:
    base = domain.view(spark, sf_dir, "aln_ends", known)
    ops = F.array(*(F.struct(F.col(c).alias("len"), F.lit(op).alias("op")) for c, op in (("m1", "="), ("n_ins", "I"), ("n_x", "X"), ("n_del", "D"), ("m2", "="))))
    return base.select("aln_id", "query_id", "qs", "qe", "target_id", "ts", "te", "strand", F.filter(ops, lambda o: o["len"] > 0).alias("cigar"))


def _all(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    known: dict = {}
    return (domain.view(spark, sf_dir, "regions", known), projection.entries(alignments(spark, sf_dir, known)), domain.view(spark, sf_dir, "seqs", known))


domain.DUCK_ONLY |= {
    "ent": """SELECT aln_id, false AS rev, query_id, qs, qe, target_id, ts, te, strand FROM {aln_ends}
        UNION ALL SELECT aln_id, true, target_id, ts, te, query_id, qs, qe, strand FROM {aln_ends} WHERE query_id <> target_id""",
    "ops": """SELECT aln_id, i, op, len FROM (SELECT aln_id, unnest([1, 2, 3, 4, 5]) AS i, unnest(['=', 'I', 'X', 'D', '=']) AS op, unnest([m1, n_ins, n_x, n_del, m2]) AS len FROM {aln_ends}) WHERE len > 0""",
    "eops": """SELECT *, coalesce(sum(CASE WHEN op = 'I' THEN 0 ELSE len END) OVER w, 0)::INT AS t0, coalesce(sum(CASE WHEN op = 'D' THEN 0 ELSE len END) OVER w, 0)::INT AS q0
        FROM (SELECT e.aln_id, e.rev, CASE WHEN e.rev AND e.strand = '-' THEN -o.i ELSE o.i END AS ord,
                     CASE WHEN e.rev AND o.op = 'I' THEN 'D' WHEN e.rev AND o.op = 'D' THEN 'I' ELSE o.op END AS op, o.len FROM {ent} e JOIN {ops} o ON e.aln_id = o.aln_id)
        WINDOW w AS (PARTITION BY aln_id, rev ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
}


def hits_sql(regions: str) -> str:
    return f"""
    SELECT region_id, aln_id, rev, query_id, arg_min(qb, ord) AS q_first, arg_max(qz, ord) AS q_last, target_id, arg_min(tb, ord) AS t_first, arg_max(tz, ord) AS t_last,
           sum(CASE WHEN op IN ('=', 'M') THEN tz - tb ELSE 0 END) AS n_match, sum(CASE WHEN op IN ('=', 'M', 'X') THEN tz - tb ELSE 0 END) AS n_base, count(*) FILTER (op IN ('I', 'D')) AS n_gap
    FROM (SELECT *, CASE WHEN op = 'I' THEN t ELSE ob END AS tb, CASE WHEN op = 'I' THEN t ELSE oz END AS tz,
                 CASE WHEN op IN ('I', 'D') THEN q ELSE q + dir * (ob - t) END AS qb,
                 CASE WHEN op = 'I' THEN q + dir * len WHEN op = 'D' THEN q ELSE q + dir * (oz - t) END AS qz
          FROM (SELECT *, greatest(t, r_start) AS ob, least(t + CASE WHEN op = 'I' THEN 0 ELSE len END, CASE WHEN op = 'D' THEN lim ELSE r_end END) AS oz
                FROM (SELECT r.region_id, r.r_start, r.r_end, e.aln_id, e.rev, e.query_id, e.target_id, o.ord, o.op, o.len, e.ts + o.t0 AS t,
                             CASE WHEN e.strand = '-' THEN e.qe - o.q0 ELSE e.qs + o.q0 END AS q, CASE WHEN e.strand = '-' THEN -1 ELSE 1 END AS dir, least(e.te, r.r_end) AS lim
                      FROM {regions} r JOIN ent e ON e.target_id = r.seq_id AND e.ts < r.r_end AND r.r_start < e.te
                      JOIN eops o ON o.aln_id = e.aln_id AND o.rev = e.rev))
          WHERE t <= lim AND CASE WHEN op = 'I' THEN t >= r_start ELSE ob < oz END)
    GROUP BY region_id, aln_id, rev, query_id, target_id
    HAVING arg_min(qb, ord) <> arg_max(qz, ord) AND arg_min(tb, ord) <> arg_max(tz, ord)"""


domain.DUCK_ONLY |= {
    "hits0": hits_sql("{regions}").replace("JOIN ent ", "JOIN {ent} ").replace("JOIN eops ", "JOIN {eops} "),
    "hits": "SELECT region_id, query_id, q_first, q_last, target_id, t_first, t_last FROM {hits0} UNION ALL SELECT region_id, seq_id, r_start, r_end, seq_id, r_start, r_end FROM {regions}",
    "fwd": "SELECT *, least(q_first, q_last) AS q_start, greatest(q_first, q_last) AS q_end, CASE WHEN q_first <= q_last THEN '+' ELSE '-' END AS strand FROM {hits}",
}


domain.DUCK_ONLY |= {
    "covered": "SELECT target_id AS seq_id, ts AS start, te AS stop FROM {aln_ends}",
    # A tracepoint ends with the operation that brings the target offset since the last one to 50.
    "fulls": """SELECT aln_id, unnest([1, 2, 3, 4, 5]) AS i, unnest([a1 >= 50, false, a3 >= 50, a4 >= 50, a5 >= 50]) AS full_ FROM (
        SELECT *, CASE WHEN a4 >= 50 THEN 0 ELSE a4 END + m2 AS a5 FROM (SELECT *, CASE WHEN a3 >= 50 THEN 0 ELSE a3 END + n_del AS a4 FROM (
        SELECT *, m1 AS a1, CASE WHEN m1 >= 50 THEN 0 ELSE m1 END + n_x AS a3 FROM {aln_ends})))""",
}


def merge_sql(source: str, keys: str, start: str, stop: str, d: int) -> str:
    """Gaps and islands in SQL."""
    return f"""SELECT {keys}, min({start}) AS {start}, max({stop}) AS {stop}, count(*) AS n_merged FROM (
        SELECT *, sum(fresh) OVER (PARTITION BY {keys} ORDER BY {start}, {stop} ROWS UNBOUNDED PRECEDING) AS run FROM (
            SELECT *, CASE WHEN {start} <= max({stop}) OVER (PARTITION BY {keys} ORDER BY {start}, {stop} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {d} THEN 0 ELSE 1 END AS fresh FROM {source}))
        GROUP BY {keys}, run"""


def query_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions, found, _ = _all(spark, sf_dir)
    return projection.query(regions, found)


def query_unidirectional(spark: SparkSession, sf_dir: str) -> DataFrame:
    known: dict = {}
    found = projection.entries(alignments(spark, sf_dir, known), bidirectional=False)
    return projection.query(domain.view(spark, sf_dir, "regions", known), found)


def query_bed_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions, found, seqs = _all(spark, sf_dir)
    joined = projection.query_merged(regions, found, 1000)
    rows = joined.select("region_id", "query_id", F.col("q_start").alias("q_first"), F.col("q_end").alias("q_last"))
    return projection.bed(rows, seqs, F.col("region_id"))


def query_merged_by_strand(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions, found, _ = _all(spark, sf_dir)
    return projection.query_merged(regions, found, 500, by_strand=True)


def query_identity_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions, found, _ = _all(spark, sf_dir)
    return projection.query(regions, found, min_identity=0.95, min_length=50, with_self=False)


def query_paf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits with their clipped CIGARs' matches and lengths, as PAF columns 10 and 11."""
    regions, found, _ = _all(spark, sf_dir)
    return projection.query(regions, found, with_stats=True, with_self=False).select(
        "region_id", "query_id", "q_first", "q_last", "target_id", "t_first", "t_last", "matches",
        (F.col("matches") + F.col("mismatches") + F.col("inserted") + F.col("deleted")).alias("block"))


def query_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits on sequences of one haplotype, or on the target itself."""
    regions, found, seqs = _all(spark, sf_dir)
    hits = projection.query(regions, found)
    return projection.with_subset(hits, seqs, seqs.where(F.element_at(F.split("name", "#"), 2) == "1").select("seq_id"))


def transitive_depth2(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions, found, _ = _all(spark, sf_dir)
    return projection.transitive(regions, found, max_depth=2).select("region_id", "depth", "query_id", "q_first", "q_last", "target_id", "t_first", "t_last")


def approximate_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    known: dict = {}
    aln = alignments(spark, sf_dir, known)
    found = aln.withColumn("trace", projection.tracepoints(F.col("cigar"), 50))
    return projection.approximate(domain.view(spark, sf_dir, "regions", known), found)


def bidirectional_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found, _ = _all(spark, sf_dir)
    return found.select("aln_id", "reversed", "query_id", "qs", "qe", "target_id", "ts", "te", "strand", cigar.render(F.col("cigar")).alias("cigar"))


def cigar_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsing and rendering a CIGAR string keeps it, so both sides start from the columns."""
    aln = alignments(spark, sf_dir).withColumn("cigar", cigar.parse(cigar.render(F.col("cigar"))))
    return aln.select("aln_id", F.round(cigar.gap_compressed_identity(F.col("cigar")), 9).alias("identity"), cigar.target_span(F.col("cigar")).alias("t_span"), cigar.query_span(F.col("cigar")).alias("q_span"))


def interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = domain.view(spark, sf_dir, "spans")
    return intervals.merge(spans, ["seq_id"], "start", "stop", 300_000).select("seq_id", "start", "stop", "n_merged")


def interval_subtract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time of a user's events that none of its purchases covers."""
    spans = domain.view(spark, sf_dir, "spans").select("seq_id", "start", "stop", "strand")
    return intervals.subtract(spans, spans.where("strand = 'error'"), ["seq_id"], "start", "stop")


def interval_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = domain.view(spark, sf_dir, "spans")
    a, b = spans.where("strand = 'click'").select("seq_id", "start", "stop"), spans.where("strand = 'error'").select("seq_id", "start", "stop")
    return intervals.intersect(a, b, ["seq_id"], "start", "stop", width=3_600_000)


def interval_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _semi(spark, sf_dir, "left_semi")


def interval_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _semi(spark, sf_dir, "left_anti")


def _semi(spark: SparkSession, sf_dir: str, how: str) -> DataFrame:
    """Regions that some alignment on their sequence overlaps, or that none does."""
    known: dict = {}
    regions, aln = domain.view(spark, sf_dir, "regions", known), domain.view(spark, sf_dir, "aln_ends", known).select("target_id", "ts", "te")
    return intervals.overlap_join(regions, aln, [("seq_id", "target_id")], ("r_start", "r_end"), ("ts", "te"), how)


def interval_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    known: dict = {}
    aln, seqs = domain.view(spark, sf_dir, "aln_ends", known), domain.view(spark, sf_dir, "seqs", known)
    covered = aln.select(F.col("target_id").alias("seq_id"), F.col("ts").alias("start"), F.col("te").alias("stop"))
    return intervals.complement(covered, seqs, "seq_id", "start", "stop")


def interval_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    known: dict = {}
    covered = domain.view(spark, sf_dir, "aln_ends", known).select(F.col("target_id").alias("seq_id"), F.col("ts").alias("start"), F.col("te").alias("stop"))
    return intervals.depth_runs(covered, ["seq_id"], "start", "stop").select("seq_id", "start", "stop", "depth")


def interval_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    aln = domain.view(spark, sf_dir, "aln_ends").select(F.col("target_id").alias("seq_id"), F.col("ts").alias("start"), F.col("te").alias("stop"))
    return intervals.contained_dropped(aln, ["seq_id"], "start", "stop")


def tile_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = domain.view(spark, sf_dir, "regions")
    return intervals.tile(regions, "r_start", "r_end", 400, fold_tail=True).select("region_id", "window", "r_start", "r_end")


def phase_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = domain.view(spark, sf_dir, "regions")
    return intervals.tile(regions, "r_start", "r_end", 300).select("region_id", "window", "r_start", "r_end")


def snapped_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    known: dict = {}
    regions = domain.view(spark, sf_dir, "regions", known).join(domain.view(spark, sf_dir, "seqs", known).select("seq_id", "length"), "seq_id")
    return intervals.snap_to_ends(regions, "r_start", "r_end", "length", 110_000).select("region_id", "r_start", "r_end")


def refine_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions, found, seqs = _all(spark, sf_dir)
    return refine.refine(regions, found, seqs)


_FROM_REGIONS = ("regions", "ent", "eops")
QUERIES = {f.__name__: f for f in (
    query_bed_merged, query_hits, query_unidirectional, query_merged_by_strand, query_identity_filter, query_paf, query_subset, transitive_depth2, approximate_hits,
    bidirectional_entries, cigar_identity, interval_merge, interval_subtract, interval_intersect, interval_semi, interval_anti, interval_complement, interval_depth,
    interval_contained, tile_windows, phase_blocks, snapped_regions, refine_regions,
)}
def _refine_pass(k: int, lefts: str, rights: str, before: str) -> str:
    """Common table expressions of one pass of the refinement: candidates, their support, the best of each region."""
    return f"""
    n{k} AS (SELECT row_number() OVER () AS region_id, own, l, r, seq_id, greatest(0, o_start - l) AS r_start, least(1000000, o_end + r) AS r_end FROM (
        SELECT g.region_id AS own, g.seq_id, g.r_start AS o_start, g.r_end AS o_end, unnest({lefts}) AS l, r FROM (SELECT g.*, {before} unnest({rights}) AS r FROM {'regions g' if k == 1 else f'regions g JOIN b{k - 1} b ON b.own = g.region_id'}) g)),
    h{k} AS ({hits_sql(f'n{k}')}),
    s{k} AS (SELECT *, row_number() OVER (PARTITION BY region_id, query_id, strand ORDER BY t_first, t_last, qs, qe) AS rn FROM (
        SELECT region_id, query_id, CASE WHEN q_first <= q_last THEN '+' ELSE '-' END AS strand, t_first, t_last, least(q_first, q_last) AS qs, greatest(q_first, q_last) AS qe FROM h{k})),
    f{k} AS (SELECT region_id, query_id, strand, rn, t_first AS a0, t_last AS a1, qs AS b0, qe AS b1, 1 AS run FROM s{k} WHERE rn = 1 UNION ALL
        SELECT region_id, query_id, strand, rn, CASE WHEN near THEN least(a0, t_first) ELSE t_first END, CASE WHEN near THEN greatest(a1, t_last) ELSE t_last END,
               CASE WHEN near THEN least(b0, qs) ELSE qs END, CASE WHEN near THEN greatest(b1, qe) ELSE qe END, CASE WHEN near THEN run ELSE run + 1 END FROM (
            SELECT s.*, f.a0, f.a1, f.b0, f.b1, f.run, least(abs(s.t_first - f.a1), abs(f.a0 - s.t_last)) <= 10000 OR least(abs(s.qs - f.b1), abs(f.b0 - s.qe)) <= 10000 AS near
            FROM f{k} f JOIN s{k} s ON s.region_id = f.region_id AND s.query_id = f.query_id AND s.strand = f.strand AND s.rn = f.rn + 1)),
    m{k} AS (SELECT region_id, query_id, strand, arg_max(a0, rn) AS t_first, arg_max(a1, rn) AS t_last FROM f{k} GROUP BY region_id, query_id, strand, run),
    p{k} AS (SELECT n.region_id, count(DISTINCT split_part(q.name, '#', 1) || '#' || split_part(q.name, '#', 2)) AS support FROM m{k} m JOIN n{k} n ON n.region_id = m.region_id JOIN seqs q ON q.seq_id = m.query_id
        WHERE m.query_id <> n.seq_id AND t_first <= n.r_start + least(1000, n.r_end - n.r_start) AND t_last >= n.r_end - least(1000, n.r_end - n.r_start) GROUP BY n.region_id),
    b{k} AS (SELECT own, seq_id, r_start, r_end, l, r, support FROM (SELECT n.*, coalesce(p.support, 0) AS support,
        row_number() OVER (PARTITION BY own ORDER BY coalesce(p.support, 0) DESC, l + r, greatest(l, r), r_end - r_start, l) AS rank FROM n{k} n LEFT JOIN p{k} p ON p.region_id = n.region_id) WHERE rank = 1)"""


_REFINE = "WITH RECURSIVE " + ",".join((
    _refine_pass(1, "range(0, 10001, 1000)", "[0]", ""), _refine_pass(2, "[g.bl]", "range(0, 10001, 1000)", "b.l AS bl,"), _refine_pass(3, "range(0, 10001, 1000)", "[b.r]", ""),
)).lstrip() + " SELECT own AS region_id, seq_id, r_start::INT AS r_start, r_end::INT AS r_end, l::INT AS \"left\", r::INT AS \"right\", support FROM b3"
_LEVEL2 = f"""
    WITH l0 AS (SELECT * FROM hits),
    nw AS (SELECT region_id, query_id AS seq_id, least(q_first, q_last) AS start, greatest(q_first, q_last) AS stop FROM l0 WHERE query_id <> target_id),
    al AS (SELECT region_id, seq_id, start, stop, 1 AS n FROM nw UNION ALL SELECT region_id, seq_id, r_start, r_end, 0 FROM regions),
    ed AS (SELECT region_id, seq_id, pos, sum(d) AS d, sum(v) AS v FROM (SELECT region_id, seq_id, start AS pos, n AS d, 1 - n AS v FROM al UNION ALL SELECT region_id, seq_id, stop, -n, n - 1 FROM al) GROUP BY ALL),
    sw AS (SELECT region_id, seq_id, pos AS start, lead(pos) OVER w AS stop, sum(d) OVER w AS d, sum(v) OVER w AS v FROM ed WINDOW w AS (PARTITION BY region_id, seq_id ORDER BY pos)),
    fr AS (SELECT region_id, seq_id, start, stop FROM sw WHERE d > 0 AND v = 0),
    ft AS (SELECT region_id, seq_id, start AS r_start, stop AS r_end FROM ({merge_sql('fr', 'region_id, seq_id', 'start', 'stop', 0)})),
    -- One row for each frontier range, so that hits of two ranges of a region stay apart.
    fi AS (SELECT row_number() OVER () AS region_id, region_id AS own, seq_id, r_start, r_end FROM ft),
    h1 AS ({hits_sql('fi')})
    SELECT region_id, 0 AS depth, query_id, q_first, q_last, target_id, t_first, t_last FROM l0
    UNION ALL SELECT fi.own, 1, h1.query_id, q_first, q_last, target_id, t_first, t_last FROM h1 JOIN fi ON fi.region_id = h1.region_id"""
SQL = {
    "refine_regions": duck(_REFINE, "regions", "ent", "eops", "seqs"),
    "transitive_depth2": duck(_LEVEL2, "hits", "regions", "ent", "eops"),
    "query_hits": duck("SELECT * FROM hits", "hits"),
    "query_unidirectional": duck("SELECT region_id, query_id, q_first, q_last, target_id, t_first, t_last FROM hits0 WHERE NOT rev UNION ALL SELECT region_id, seq_id, r_start, r_end, seq_id, r_start, r_end FROM regions", "hits0"),
    "query_bed_merged": duck(f"SELECT s.name AS chrom, q_start AS start, q_end AS \"end\", region_id::VARCHAR AS name, '.' AS score, '+' AS strand FROM ({merge_sql('fwd', 'region_id, query_id', 'q_start', 'q_end', 1000)}) m JOIN seqs s ON s.seq_id = m.query_id", "fwd", "seqs"),
    "query_merged_by_strand": duck(merge_sql("fwd", "region_id, query_id, strand", "q_start", "q_end", 500), "fwd"),
    "query_identity_filter": duck("SELECT region_id, query_id, q_first, q_last, target_id, t_first, t_last FROM hits0 WHERE n_match / (n_base + n_gap) >= 0.95 AND abs(q_last - q_first) >= 50", "hits0"),
    "query_paf": duck("SELECT region_id, query_id, q_first, q_last, target_id, t_first, t_last, n_match::BIGINT AS matches, (n_base + abs(q_last - q_first) - n_base + abs(t_last - t_first) - n_base)::BIGINT AS block FROM hits0", "hits0"),
    "query_subset": duck("SELECT h.* FROM hits h JOIN seqs s ON s.seq_id = h.query_id WHERE split_part(s.name, '#', 2) = '1' OR h.query_id = h.target_id", "hits", "seqs"),
    "approximate_hits": duck("""
        WITH st AS (SELECT *, sum(CASE WHEN full_ THEN 1 ELSE 0 END) OVER (PARTITION BY aln_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS grp FROM (
            SELECT o.aln_id, o.i, CASE WHEN o.op = 'I' THEN 0 ELSE o.len END AS dt, CASE WHEN o.op = 'D' THEN 0 ELSE o.len END AS dq, f.full_ FROM ops o JOIN fulls f ON f.aln_id = o.aln_id AND f.i = o.i)),
        tr AS (SELECT aln_id, coalesce(grp, 0) AS g, sum(dt) AS dt, sum(dq) AS dq FROM st GROUP BY aln_id, coalesce(grp, 0)),
        tp AS (SELECT *, coalesce(sum(dt) OVER w, 0) AS t0, coalesce(sum(dq) OVER w, 0) AS q0 FROM tr WINDOW w AS (PARTITION BY aln_id ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        j AS (SELECT r.region_id, a.*, greatest(r.r_start, a.ts) AS t_first, least(r.r_end, a.te) AS t_last FROM regions r JOIN aln_ends a ON a.target_id = r.seq_id AND a.ts < r.r_end AND r.r_start < a.te),
        p AS (SELECT j.region_id, j.aln_id, j.query_id, j.target_id, j.qs, j.qe, j.strand, j.t_first, j.t_last,
                     arg_min(q0 + CASE WHEN dt > 0 THEN (2 * (j.t_first - j.ts - t0) * dq + dt) // (2 * dt) ELSE 0 END, g) FILTER (j.t_first - j.ts <= t0 + dt) AS a,
                     arg_min(q0 + CASE WHEN dt > 0 THEN (2 * (j.t_last - j.ts - t0) * dq + dt) // (2 * dt) ELSE 0 END, g) FILTER (j.t_last - j.ts <= t0 + dt) AS b
              FROM j JOIN tp ON tp.aln_id = j.aln_id GROUP BY ALL)
        SELECT region_id, query_id, CASE WHEN strand = '-' THEN qe - a::INT ELSE qs + a::INT END AS q_first,
               CASE WHEN strand = '-' THEN qe - b::INT ELSE qs + b::INT END AS q_last, target_id, t_first, t_last FROM p WHERE a <> b""", "regions", "ops", "aln_ends", "fulls"),
    "bidirectional_entries": duck("""
        WITH o AS (SELECT *, m1 || '=' AS a, CASE WHEN n_x > 0 THEN n_x || 'X' ELSE '' END AS x, m2 || '=' AS z, CASE WHEN n_ins > 0 THEN n_ins || 'I' ELSE '' END AS i, CASE WHEN n_del > 0 THEN n_del || 'D' ELSE '' END AS d FROM aln_ends)
        SELECT aln_id, false AS reversed, query_id, qs, qe, target_id, ts, te, strand, a || i || x || d || z AS cigar FROM o
        UNION ALL SELECT aln_id, true, target_id, ts, te, query_id, qs, qe, strand,
            CASE WHEN strand = '-' THEN z || replace(d, 'D', 'I') || x || replace(i, 'I', 'D') || a ELSE a || replace(i, 'I', 'D') || x || replace(d, 'D', 'I') || z END FROM o WHERE query_id <> target_id""", "aln_ends"),
    "cigar_identity": duck("SELECT aln_id, round((m1 + m2) / (m1 + m2 + n_x + CASE WHEN n_ins > 0 THEN 1 ELSE 0 END + CASE WHEN n_del > 0 THEN 1 ELSE 0 END), 9) AS identity, te - ts AS t_span, qe - qs AS q_span FROM aln_ends", "aln_ends"),
    "interval_merge": duck(merge_sql("spans", "seq_id", "start", "stop", 300_000), "spans"),
    "interval_subtract": duck(f"""
        WITH c AS (SELECT DISTINCT seq_id, pos FROM (SELECT seq_id, start AS pos FROM spans UNION ALL SELECT seq_id, stop FROM spans)),
        p AS (SELECT seq_id, pos AS start, lead(pos) OVER (PARTITION BY seq_id ORDER BY pos) AS stop FROM c),
        k AS (SELECT p.seq_id, p.start, p.stop FROM p WHERE p.stop IS NOT NULL AND EXISTS (SELECT 1 FROM spans s WHERE s.seq_id = p.seq_id AND s.start < p.stop AND p.start < s.stop)
              AND NOT EXISTS (SELECT 1 FROM spans s WHERE s.strand = 'error' AND s.seq_id = p.seq_id AND s.start < p.stop AND p.start < s.stop))
        SELECT seq_id, start, stop FROM ({merge_sql('k', 'seq_id', 'start', 'stop', 0)})""", "spans"),
    "interval_intersect": duck("SELECT a.seq_id, greatest(a.start, b.start) AS start, least(a.stop, b.stop) AS stop FROM spans a JOIN spans b ON a.seq_id = b.seq_id AND a.start < b.stop AND b.start < a.stop WHERE a.strand = 'click' AND b.strand = 'error'", "spans"),
    "interval_semi": duck("SELECT * FROM regions r WHERE EXISTS (SELECT 1 FROM aln_ends a WHERE a.target_id = r.seq_id AND a.ts < r.r_end AND r.r_start < a.te)", "regions", "aln_ends"),
    "interval_anti": duck("SELECT * FROM regions r WHERE NOT EXISTS (SELECT 1 FROM aln_ends a WHERE a.target_id = r.seq_id AND a.ts < r.r_end AND r.r_start < a.te)", "regions", "aln_ends"),
    "interval_complement": duck(f"""
        WITH m AS ({merge_sql('covered', 'seq_id', 'start', 'stop', 0)}),
        g AS (SELECT seq_id, stop AS start, lead(start) OVER (PARTITION BY seq_id ORDER BY start) AS nxt FROM m)
        SELECT seq_id, start, coalesce(nxt, 1000000)::INT AS stop FROM g WHERE coalesce(nxt, 1000000) > start
        UNION ALL SELECT s.seq_id, 0, coalesce(f.start, 1000000)::INT FROM seqs s LEFT JOIN (SELECT seq_id, min(start) AS start FROM m GROUP BY seq_id) f ON f.seq_id = s.seq_id WHERE coalesce(f.start, 1000000) > 0""", "covered", "seqs"),
    "interval_depth": duck("""
        WITH e AS (SELECT seq_id, pos, sum(d) AS d FROM (SELECT seq_id, start AS pos, 1 AS d FROM covered UNION ALL SELECT seq_id, stop, -1 FROM covered) GROUP BY seq_id, pos HAVING sum(d) <> 0),
        r AS (SELECT seq_id, pos AS start, lead(pos) OVER w AS stop, sum(d) OVER w AS depth FROM e WINDOW w AS (PARTITION BY seq_id ORDER BY pos))
        SELECT seq_id, start, stop, depth::BIGINT AS depth FROM r WHERE depth > 0 AND stop IS NOT NULL""", "covered"),
    "interval_contained": duck("""
        WITH c AS (SELECT DISTINCT seq_id, start, stop FROM covered)
        SELECT seq_id, start, stop FROM (SELECT *, max(stop) OVER (PARTITION BY seq_id ORDER BY start, stop DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM c) WHERE reach IS NULL OR stop > reach""", "covered"),
    "tile_windows": duck("""
        WITH n AS (SELECT *, greatest(1, (r_end - r_start) // 400) AS n FROM regions)
        SELECT region_id, w::INT AS "window", (r_start + w * 400)::INT AS r_start, (CASE WHEN w = n - 1 THEN r_end ELSE r_start + (w + 1) * 400 END)::INT AS r_end FROM (SELECT *, unnest(range(n)) AS w FROM n)""", "regions"),
    "phase_blocks": duck("SELECT region_id, ((s - r_start) // 300)::INT AS \"window\", s::INT AS r_start, least(s + 300, r_end)::INT AS r_end FROM (SELECT *, unnest(range(r_start, r_end, 300)) AS s FROM regions)", "regions"),
    "snapped_regions": duck("SELECT region_id, CASE WHEN r_start < 110000 THEN 0 ELSE r_start END AS r_start, CASE WHEN 1000000 - r_end < 110000 THEN 1000000 ELSE r_end END AS r_end FROM regions", "regions"),
}
