"""Queries over syncmer walks, partitions, lacing, formats and streams, and what DuckDB must get."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan import session
from loomspan.operators import cigar, graph, lace, partition, projection, syncmer
from loomspan.plans import domain, graph_queries  # noqa: F401  (its views are used here)
from loomspan.plans.alignment_queries import alignments, hits_sql, merge_sql
from loomspan.plans.domain import duck
from loomspan.sources import text_formats, writers
from loomspan.streaming import counts

K, S = 15, 6


def _walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The walks of all paths."""
    known: dict = {}
    segments, steps = domain.view(spark, sf_dir, "segments", known), domain.view(spark, sf_dir, "steps", known)
    return syncmer.extract(graph.spellings(segments, steps).withColumnRenamed("spelling", "seq"), K, S)


def syncmer_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _walks(spark, sf_dir).select("path_id", "step", "pos", "kmer", "orient")


def syncmer_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmer.dictionary(_walks(spark, sf_dir))


def syncmer_frequent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmer.frequent_nodes(_walks(spark, sf_dir), 0.01, "kmer")


def syncmer_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every path's chains with every other."""
    walk = _walks(spark, sf_dir)
    found = syncmer.chains(syncmer.anchors(walk, walk), K, 50, 2)
    return found.select("q_id", "t_id", "strand", "q_start", "q_end", "t_start", "t_end", "n_anchors")


def syncmer_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every path's matches with every other."""
    walk = _walks(spark, sf_dir)
    return syncmer.walk_matches(walk, walk)


def partition_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    known: dict = {}
    found = projection.entries(alignments(spark, sf_dir, known))
    return partition.partition(domain.view(spark, sf_dir, "seqs", known), found, 100_000, 2000).select("seq_id", "start", "stop", "rank")


def partition_rehomed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition.rehome_singletons(partition_windows(spark, sf_dir), ["rank"])


def lace_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = domain.view(spark, sf_dir, "regions").select(F.col("seq_id").alias("key"), F.col("r_start").alias("start"), F.col("r_end").alias("stop"))
    return lace.lace(regions)


def lace_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window for each supplier, a sample for each line number."""
    steps = domain.view(spark, sf_dir, "aln_base")
    calls = steps.select(
        F.format_string("c%d:%d-%d", F.col("query_id"), F.col("query_id") * 1000, F.col("query_id") * 1000 + 1000).alias("chrom"), (F.col("ts") % 1000 + 1).cast("long").alias("pos"),
        F.lit("A").alias("ref"), F.when(F.col("strand") == "-", "C").otherwise("G").alias("alt"), F.format_string("s%d", F.col("n_ins")).alias("sample"), F.when(F.col("n_del") > 3, "0/1").otherwise("1/1").alias("gt"))
    return lace.lace_vcf(calls)


def unused_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that no finished order has."""
    known: dict = {}
    done = domain.view(spark, sf_dir, "orders", known).where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("path_id"))
    steps = domain.view(spark, sf_dir, "steps", known).join(done, "path_id", "left_semi")
    return lace.unused_segments(domain.view(spark, sf_dir, "segments", known), steps).select("seg_id", "len")


def _folder(spark: SparkSession) -> str:
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        session.cut(spark.range(1))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base}/loomspan-text-{uuid.uuid4().hex}"


def paf_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All alignments written as PAF and read back."""
    known: dict = {}
    names = domain.view(spark, sf_dir, "seqs", known)
    q, t = (names.select(F.col("seq_id").alias(f"{s}_id"), F.col("name").alias(s), F.col("length").alias(f"{s[0]}len")) for s in ("query", "target"))
    rows = alignments(spark, sf_dir, known).join(session.lookup(q), "query_id").join(session.lookup(t), "target_id")
    path = _folder(spark)
    writers.write(writers.paf_lines(rows), path)
    back = text_formats.read_paf(spark, path)
    return back.select("query", "qs", "qe", "strand", "target", "ts", "te", "matches", "block", cigar.render(F.col("cigar")).alias("cigar"))


def gfa_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph written as GFA and read back: its steps with their segments' lengths."""
    known: dict = {}
    path = _folder(spark)
    writers.write(writers.gfa_lines(*(domain.view(spark, sf_dir, n, known) for n in ("segments", "links", "steps"))), path)
    segments, _, steps = text_formats.read_gfa(spark, path)
    return steps.join(segments, "name").select("path", "idx", "name", "orient", "len")


def stream_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as a stream and counted by hour and type."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    return counts.drained(counts.windowed_counts(stream), spark).select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")


def session_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same merge as of intervals, by session windows over the batch."""
    events = domain.view(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    found = events.groupBy(F.session_window("ts", "10 minutes"), "user_id").agg(F.count("*").alias("n"))
    return found.select("user_id", F.expr("unix_micros(session_window.start) div 1000").alias("start"), "n")


QUERIES = {f.__name__: f for f in (
    syncmer_walks, syncmer_dictionary, syncmer_frequent, syncmer_chains, syncmer_matches, partition_windows, partition_rehomed, lace_fragments, lace_variants, unused_segments,
    paf_round_trip, gfa_round_trip, stream_hourly, session_merge,
)}

domain.DUCK_ONLY |= {
    "mers": f"SELECT path_id, i AS pos, spelling[i + 1 : i + {K}] AS kmer FROM (SELECT *, unnest(range(length(spelling) - {K - 1})) AS i FROM {{spelt}} WHERE length(spelling) >= {K})",
    "walk": f"""SELECT path_id, pos, least(kmer, rc) AS kmer, CASE WHEN kmer <= rc THEN 1 ELSE -1 END AS orient, row_number() OVER (PARTITION BY path_id ORDER BY pos) - 1 AS step
        FROM (SELECT *, reverse(translate(kmer, 'ACGT', 'TGCA')) AS rc, list_transform(range({K - S + 1}), lambda j: kmer[j + 1 : j + {S}]) AS s FROM {{mers}})
        WHERE list_position(s, list_min(s)) IN (1, {K - S + 1})""",
    "asked": "SELECT * FROM {walk}",
    "anch": f"""SELECT q_id, t_id, strand, q_pos AS q_start, q_pos + {K} AS q_end, t_pos FROM (
        SELECT q_id, t_id, strand, diag, node, min(struct_pack(q := q_pos, t := t_pos)).q AS q_pos, min(struct_pack(q := q_pos, t := t_pos)).t AS t_pos FROM (
            SELECT q.path_id AS q_id, t.path_id AS t_id, q.kmer AS node, CASE WHEN q.orient = t.orient THEN '+' ELSE '-' END AS strand, q.pos AS q_pos, t.pos AS t_pos,
                   CASE WHEN q.orient = t.orient THEN t.pos - q.pos ELSE t.pos + q.pos END AS diag FROM {{asked}} q JOIN {{walk}} t ON q.kmer = t.kmer AND q.path_id <> t.path_id) GROUP BY q_id, t_id, strand, diag, node)""",
}
SQL = {
    "syncmer_walks": duck("SELECT path_id, step, pos, kmer, orient FROM walk", "walk"),
    "syncmer_dictionary": duck("SELECT row_number() OVER (ORDER BY kmer) AS node_id, kmer FROM (SELECT DISTINCT kmer FROM walk)", "walk"),
    "syncmer_frequent": duck("WITH c AS (SELECT kmer, count(*) AS n FROM walk GROUP BY kmer) SELECT kmer FROM (SELECT kmer, row_number() OVER (ORDER BY n DESC, kmer) AS k FROM c) WHERE k <= (SELECT floor(count(*) * 0.01) FROM c)", "walk"),
    "syncmer_chains": duck("""SELECT q_id, t_id, strand, min(q_start) AS q_start, max(q_end) AS q_end, min(t_pos) AS t_start, max(t_pos) + 15 AS t_end, count(*) AS n_anchors FROM (
        SELECT *, sum(fresh) OVER (PARTITION BY q_id, t_id, strand ORDER BY q_start, q_end ROWS UNBOUNDED PRECEDING) AS run FROM (
            SELECT *, CASE WHEN q_start <= max(q_end) OVER (PARTITION BY q_id, t_id, strand ORDER BY q_start, q_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 50 THEN 0 ELSE 1 END AS fresh FROM anch))
        GROUP BY q_id, t_id, strand, run HAVING count(*) >= 2""", "anch"),
    "syncmer_matches": duck("""
        WITH m AS (SELECT q.path_id AS q_id, t.path_id AS t_id, q.step AS q_step, t.step AS t_step, q.pos AS q_pos, t.pos - q.pos AS d, t.step - q.step AS e FROM asked q JOIN walk t ON q.kmer = t.kmer AND q.orient = t.orient AND q.path_id <> t.path_id),
        r AS (SELECT *, q_step - row_number() OVER (PARTITION BY q_id, t_id, d, e ORDER BY q_step) AS run FROM m)
        SELECT q_id, t_id, min(q_step) AS q_step, min(t_step) AS t_step, count(*) AS steps, min(q_pos) AS q_pos FROM r GROUP BY q_id, t_id, d, e, run HAVING count(*) >= 2""", "asked", "walk"),
    "lace_fragments": duck("""
        WITH c AS (SELECT DISTINCT seq_id AS key, r_start AS start, r_end AS stop FROM regions),
        k AS (SELECT key, start, stop FROM (SELECT *, max(stop) OVER (PARTITION BY key ORDER BY start, stop DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM c) WHERE reach IS NULL OR stop > reach),
        b AS (SELECT *, lag(stop) OVER (PARTITION BY key ORDER BY start) AS before FROM k),
        p AS (SELECT key, 'range' AS kind, greatest(start, coalesce(before, start)) AS start, stop FROM b UNION ALL SELECT key, 'gap', before, start FROM b WHERE before < start)
        SELECT key, (row_number() OVER (PARTITION BY key ORDER BY start) - 1)::INT AS idx, kind, start, stop FROM p""", "regions"),
    "lace_variants": duck("""
        WITH c AS (SELECT 'c' || query_id AS chrom, (ts % 1000 + 1 + query_id * 1000)::BIGINT AS pos, CASE WHEN strand = '-' THEN 'C' ELSE 'G' END AS alt, 's' || n_ins AS sample, min(CASE WHEN n_del > 3 THEN '0/1' ELSE '1/1' END) AS gt FROM aln_base GROUP BY ALL),
        v AS (SELECT DISTINCT chrom, pos, alt FROM c), n AS (SELECT DISTINCT sample FROM c)
        SELECT v.chrom, v.pos, 'A' AS ref, v.alt, string_agg(coalesce(c.gt, './.'), chr(9) ORDER BY n.sample) AS genotypes FROM v CROSS JOIN n LEFT JOIN c ON c.chrom = v.chrom AND c.pos = v.pos AND c.alt = v.alt AND c.sample = n.sample GROUP BY v.chrom, v.pos, v.alt""", "aln_base"),
    "unused_segments": duck("SELECT seg_id, len FROM segments WHERE seg_id NOT IN (SELECT s.seg_id FROM steps s JOIN orders o ON o.o_orderkey = s.path_id WHERE o.o_orderstatus = 'F')", "segments", "steps"),
    "paf_round_trip": duck("SELECT q.name AS query, a.qs, a.qe, a.strand, t.name AS target, a.ts, a.te, m1 + m2 AS matches, m1 + m2 + n_x + n_ins + n_del AS block, m1 || '=' || n_ins || 'I' || CASE WHEN n_x > 0 THEN n_x || 'X' ELSE '' END || CASE WHEN n_del > 0 THEN n_del || 'D' ELSE '' END || m2 || '=' AS cigar FROM aln_ends a JOIN seqs q ON q.seq_id = a.query_id JOIN seqs t ON t.seq_id = a.target_id", "aln_ends", "seqs"),
    "gfa_round_trip": duck("SELECT s.path_id::VARCHAR AS path, s.idx, s.seg_id::VARCHAR AS name, s.orient, g.len FROM steps s JOIN segments g ON g.seg_id = s.seg_id", "steps", "segments"),
    "stream_hourly": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n FROM events GROUP BY ALL",
    "session_merge": duck("""SELECT seq_id AS user_id, min(start) AS start, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY seq_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS run FROM (
        SELECT *, CASE WHEN us <= lag(us) OVER (PARTITION BY seq_id ORDER BY us) + 600000000 THEN 0 ELSE 1 END AS fresh FROM (SELECT user_id AS seq_id, epoch_us(ts) AS us, epoch_us(ts) // 1000 AS start FROM events))) GROUP BY seq_id, run"""),
    "partition_windows": duck(f"""
        WITH win AS (SELECT seq_id, w * 100000 AS r_start, (w + 1) * 100000 AS r_end, seq_id::BIGINT * 4294967296 + w * 100000 AS region_id FROM seqs, range(10) AS t(w)),
        h AS ({hits_sql("win")}),
        f AS (SELECT region_id AS rank, query_id AS seq_id, least(q_first, q_last) AS start, greatest(q_first, q_last) AS stop FROM h UNION ALL SELECT region_id, seq_id, r_start, r_end FROM win),
        m AS ({merge_sql('f', 'rank, seq_id', 'start', 'stop', 2000)}),
        b AS (SELECT DISTINCT seq_id, start FROM (SELECT seq_id, start FROM m UNION ALL SELECT seq_id, stop FROM m)),
        p AS (SELECT seq_id, start, lead(start) OVER (PARTITION BY seq_id ORDER BY start) AS stop FROM b),
        l AS (SELECT p.seq_id, p.start, p.stop, min(m.rank) AS rank FROM p JOIN m ON m.seq_id = p.seq_id AND m.start < p.stop AND p.start < m.stop WHERE p.stop IS NOT NULL GROUP BY ALL)
        SELECT seq_id, start::INT AS start, stop::INT AS stop, rank FROM ({merge_sql('l', 'seq_id, rank', 'start', 'stop', 0)})""", "seqs", "ent", "eops"),
}
# Passes of re-homing over the partitions that the query above gives.
SQL["partition_rehomed"] = f"""WITH RECURSIVE parts AS MATERIALIZED ({SQL["partition_windows"]}),
    r AS (SELECT 0 AS pass, seq_id, start, stop, rank, true AS moved FROM parts UNION ALL
        SELECT pass + 1, seq_id, start, stop, CASE WHEN move THEN CASE WHEN ln >= rn THEN lw ELSE rw END ELSE rank END, move FROM (
            SELECT *, n = 1 AND greatest(ln, rn) > 1 AS move FROM (
                SELECT *, CASE WHEN lag(stop) OVER w = start THEN lag(n) OVER w ELSE 0 END AS ln, lag(rank) OVER w AS lw, CASE WHEN lead(start) OVER w = stop THEN lead(n) OVER w ELSE 0 END AS rn, lead(rank) OVER w AS rw
                FROM (SELECT pass, seq_id, start, stop, rank, count(*) OVER (PARTITION BY rank) AS n, bool_or(moved) OVER () AS goes_on FROM r WHERE pass < 100) WHERE goes_on WINDOW w AS (PARTITION BY seq_id ORDER BY start)))),
    last AS (SELECT max(pass) AS pass FROM r)
    SELECT seq_id, start, stop, rank FROM r WHERE pass = (SELECT pass FROM last)"""
