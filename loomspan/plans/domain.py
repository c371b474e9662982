"""The engine's tables, derived from the driver's by integer arithmetic that Spark and DuckDB share.

Each view is one SQL text over ``{name}`` placeholders.  Spark reads it with DataFrames in their place,
DuckDB as a chain of common table expressions; so a query and its check start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS: dict[str, str] = {
    # 25 sequences of a megabase, named sample#haplotype#contig.
    "seqs": """
        SELECT CAST(n.n_nationkey AS INT) AS seq_id,
               concat(replace(r.r_name, ' ', '_'), '#', n.n_nationkey % 2, '#', replace(n.n_name, ' ', '_')) AS name,
               1000000 AS length
        FROM {nation} n JOIN {region} r ON n.n_regionkey = r.r_regionkey""",
    # One alignment for each (order, line): = I X D = with lengths from its columns, zero lengths left out.
    "aln_base": """
        SELECT l_orderkey * 8 + l_linenumber AS aln_id,
               CAST(min(l_suppkey) % 25 AS INT) AS query_id, CAST(max(l_partkey) % 25 AS INT) AS target_id,
               CAST((l_orderkey * 7919 + max(l_partkey) * 31) % 900000 AS INT) AS ts,
               CAST((l_orderkey * 104729 + min(l_suppkey) * 17) % 900000 AS INT) AS qs,
               CASE WHEN min(l_returnflag) = 'R' THEN '-' ELSE '+' END AS strand,
               CAST(max(l_quantity) * 4 AS INT) AS m1, CAST(l_linenumber AS INT) AS n_ins,
               CAST(l_linenumber % 3 AS INT) AS n_x, CAST(round(max(l_tax) * 100) AS INT) AS n_del,
               CAST(5 + round(min(l_discount) * 100) AS INT) AS m2
        FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
    "aln_ends": """
        SELECT *, ts + m1 + n_x + n_del + m2 AS te, qs + m1 + n_ins + n_x + m2 AS qe FROM {aln_base}""",
    # One region for each customer.
    "regions": """
        SELECT c_custkey AS region_id, CAST(c_nationkey AS INT) AS seq_id,
               CAST((c_custkey * 7717) % 900000 AS INT) AS r_start,
               CAST((c_custkey * 7717) % 900000 + 500 + (c_custkey * 13) % 1500 AS INT) AS r_end
        FROM {customer}""",
    # A variation graph: parts are segments, orders paths, their lines steps.
    "segments": """
        SELECT p_partkey AS seg_id, CAST(p_size AS INT) AS len,
               substr(translate(concat(md5(concat('', p_partkey)), md5(concat('x', p_partkey))), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, CAST(p_size AS INT)) AS seq
        FROM {part}""",
    "steps_base": """
        SELECT l_orderkey AS path_id, CAST(l_linenumber AS INT) AS line, min(l_partkey) AS seg_id,
               CASE WHEN max(l_returnflag) = 'R' THEN '-' ELSE '+' END AS orient
        FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
    "steps": """
        SELECT path_id, CAST(row_number() OVER (PARTITION BY path_id ORDER BY line) - 1 AS INT) AS idx, seg_id, orient FROM {steps_base}""",
    "links": """
        SELECT DISTINCT seg_id AS from_id, orient AS from_orient, to_id, to_orient
        FROM (SELECT seg_id, orient, lead(seg_id) OVER (PARTITION BY path_id ORDER BY idx) AS to_id,
                     lead(orient) OVER (PARTITION BY path_id ORDER BY idx) AS to_orient FROM {steps}) s
        WHERE to_id IS NOT NULL""",
    # Coverage of a sample (all orders of a customer) and candidate haplotypes (its single orders).
    "pack": """
        SELECT o.o_custkey AS sample_id, l.l_partkey AS node_id, count(*) AS cnt
        FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey GROUP BY o.o_custkey, l.l_partkey""",
    "cand_features": """
        SELECT o.o_custkey AS locus_id, o.o_orderkey AS cand_id, l.l_partkey AS feature_id, count(*) AS weight
        FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey GROUP BY o.o_custkey, o.o_orderkey, l.l_partkey""",
    # Intervals in time: 10 minutes from each event, per user.
    "spans": """
        SELECT user_id AS seq_id, epoch_ms AS start, epoch_ms + 600000 AS stop, event_type AS strand FROM {event_ms}""",
    # A multiple alignment for each order: rows are its parts' sequences padded to a common width.
    "msa": """
        SELECT s.path_id AS region_id, s.idx AS row_id, concat('s', g.seg_id % 7, '#', g.seg_id % 2, '#c', s.idx) AS name,
               rpad(replace(g.seq, 'GT', '--'), 50, '-') AS aligned
        FROM {steps} s JOIN {segments} g ON s.seg_id = g.seg_id""",
    # A graph with loose ends: orders are segments, customers the paths through theirs.
    "visit_segments": """
        SELECT o_orderkey AS seg_id, 1 AS len, 'A' AS seq FROM {orders}""",
    "visit_steps": """
        SELECT o_custkey AS path_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS idx, o_orderkey AS seg_id, '+' AS orient FROM {orders}""",
    "visit_links": """
        SELECT seg_id AS from_id, '+' AS from_orient, to_id, '+' AS to_orient
        FROM (SELECT seg_id, lead(seg_id) OVER (PARTITION BY path_id ORDER BY idx) AS to_id FROM {visit_steps}) s WHERE to_id IS NOT NULL""",
    # Customers pass through their nation, and then nearly all through 1; the few with large debts through 2.
    "tour_steps": """
        SELECT c_custkey AS path_id, 0 AS idx, CAST(1000 + c_nationkey AS BIGINT) AS seg_id, '+' AS orient FROM {customer}
        UNION ALL SELECT c_custkey, 1, CAST(CASE WHEN c_acctbal < -900 THEN 2 ELSE 1 END AS BIGINT), '+' FROM {customer}""",
    # Haplotypes of suppliers: three pieces of 20 bases, the outer ones for the nation, the middle one also for the key's rest by three.
    "haps": """
        SELECT s_suppkey AS seq_id, CAST(s_nationkey AS INT) AS nation, concat(p1, p2, p3) AS seq FROM (
            SELECT s_suppkey, s_nationkey,
                   substr(translate(md5(concat('a', s_nationkey)), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, 20) AS p1,
                   substr(translate(md5(concat('b', s_nationkey, '.', s_suppkey % 3)), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, 20) AS p2,
                   substr(translate(md5(concat('c', s_nationkey)), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, 20) AS p3 FROM {supplier}) p""",
    # Each haplotype aligned to the one before it of its nation (outer pieces), and to the one before it with the same middle piece.
    "hap_pairs": """
        SELECT seq_id AS query_id, lag(seq_id) OVER (PARTITION BY nation ORDER BY seq_id) AS outer_id,
               lag(seq_id) OVER (PARTITION BY nation, seq_id % 3 ORDER BY seq_id) AS middle_id FROM {haps}""",
}
#: Views whose text differs between the engines.
SPARK_ONLY = {"event_ms": "SELECT user_id, event_type, unix_micros(CAST(ts AS TIMESTAMP)) div 1000 AS epoch_ms FROM {events}"}
DUCK_ONLY = {"event_ms": "SELECT user_id, event_type, epoch_us(ts) // 1000 AS epoch_ms FROM {events}"}


def _parts(text: str) -> list[str]:
    return [p.split("}")[0] for p in text.split("{")[1:]]


def view(spark: SparkSession, sf_dir: str, name: str, known: dict[str, DataFrame] | None = None) -> DataFrame:
    """A base table or derived view as a DataFrame."""
    known = {} if known is None else known
    if name not in known:
        if name in BASE:
            known[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        else:
            text = (VIEWS | SPARK_ONLY)[name]
            known[name] = spark.sql(text, **{p: view(spark, sf_dir, p, known) for p in dict.fromkeys(_parts(text))})
    return known[name]


def duck(select: str, *names: str) -> str:
    """``select`` for DuckDB, with the views it names before it."""
    texts, order = VIEWS | DUCK_ONLY, []

    def need(name: str) -> None:
        if name in texts and name not in order:
            for p in _parts(texts[name]):
                need(p)
            order.append(name)

    for n in names:
        need(n)
    chain = [f"{n} AS ({texts[n].format(**{p: p for p in _parts(texts[n])})})" for n in order]
    body = select.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ",\n".join(chain) + (",\n" if chain else "") + body[len("WITH RECURSIVE") :]
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(chain) + (",\n" if chain else "") + body[len("WITH ") :]
    return ("WITH " + ",\n".join(chain) + "\n" if chain else "") + body
