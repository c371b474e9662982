"""Line dedup by overlapping three-line windows, with DataFrame functions only.

Every three consecutive lines of a text are hashed to 128 bits; windows that occur twice or more are
found globally, and of each all but the first occurrence (smallest ``doc_id``, then row, then line)
are struck out.  Lines that struck windows cover go, runs of them merged into intervals; the others stay.

A first pass counts windows and takes the least ``doc_id`` of each by partial hash aggregation, so a window
shared by a third of all documents costs one row for each task.  Repeated windows are few and are written to
the shared folder; the join that finds their occurrences has plain shuffles on both sides, which Spark splits
where a window is hot.  Which occurrence is first within the least ``doc_id`` is then a second such aggregation
over row and line numbers, packed into one decimal.  Whole texts are shuffled once, to meet their intervals, and nothing else carries text.

Defined cases: lines are split at ``\\n``; a text of fewer than three lines has no window and stays whole;
windows of three blank lines don't count; a null or empty text stays as it is; a text whose lines all go
becomes empty and the row stays; repeated rows and equal or null ``doc_id``s are told apart by their
place in the input; other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.llm import shared

WINDOW = 3


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n", -1)


def windows(docs: DataFrame) -> DataFrame:
    """_rid, doc_id, pos and the two hashes of every window that has a word."""
    lines = docs.select("_rid", "doc_id", _lines("text").alias("lines"))  # of rows with their numbers
    triples = F.arrays_zip(
        F.slice("lines", 1, F.size("lines") - 2).alias("a"),
        F.slice("lines", 2, F.size("lines") - 2).alias("b"),
        F.slice("lines", 3, F.size("lines") - 2).alias("c"),
    )
    return (
        lines.where(F.size("lines") >= WINDOW)
        .select("_rid", "doc_id", F.posexplode(triples).alias("pos", "w"))
        .where(F.concat("w.a", "w.b", "w.c").rlike("[^\\x20\\x09-\\x0D]"))
        .select("_rid", "doc_id", "pos", *(h.alias(n) for h, n in zip(shared.hash128("w.a", "w.b", "w.c"), ("h1", "h2"))))
    )


def struck_intervals(found: DataFrame) -> DataFrame:
    """For each row with struck windows, its covered line intervals [from, to), merged and in order."""
    nulls = F.count("*") - F.count("doc_id")
    counted = found.groupBy("h1", "h2").agg(F.count("*").alias("n"), nulls.alias("nulls"), F.min("doc_id").alias("least"))
    repeated = counted.where("n > 1").select("h1", "h2", F.when(F.col("nulls") == 0, F.col("least")).alias("first_doc"))
    met = shared.written(found.join(repeated, ["h1", "h2"]), "windows")
    # Row numbers are below 2^63 and lines below 2^31, so both fit a decimal, which hash aggregation can hold.
    place = F.col("_rid").cast("decimal(19,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col("pos").cast("decimal(10,0)")
    of_first = F.col("doc_id").eqNullSafe(F.col("first_doc"))
    firsts = met.where(of_first).groupBy("h1", "h2").agg(F.min(place).alias("first"))
    later = met.where(~of_first).select("_rid", "pos").unionByName(met.where(of_first).join(firsts, ["h1", "h2"]).where(place != F.col("first")).select("_rid", "pos"))
    order = Window.partitionBy("_rid").orderBy("pos")
    gap = F.col("pos") > F.coalesce(F.lag("pos").over(order) + WINDOW, F.lit(-1))
    runs = later.withColumn("run", F.sum(gap.cast("int")).over(order)).groupBy("_rid", "run").agg(F.min("pos").alias("from"), (F.max("pos") + WINDOW).alias("to"))
    return runs.groupBy("_rid").agg(F.array_sort(F.collect_list(F.struct("from", "to"))).alias("struck"))


def dedup_lines(docs: DataFrame, counts: bool = True) -> DataFrame:
    """``docs`` with the texts that are left and, with ``counts``, ``n_lines`` and ``n_removed`` (in place of columns of these names)."""
    numbered = shared.numbered(docs)
    struck = struck_intervals(windows(numbered.select("_rid", F.col("doc.doc_id").alias("doc_id"), F.col("doc.text").alias("text"))))
    joined = numbered.join(struck, "_rid", "left").withColumn("lines", _lines("doc.text"))
    ends = F.concat(F.array(F.lit(0)), F.transform("struck", lambda s: s["to"]))
    starts = F.concat(F.transform("struck", lambda s: s["from"]), F.array(F.size("lines")))
    kept = F.flatten(F.transform(F.arrays_zip(ends.alias("a"), starts.alias("b")), lambda g: F.slice("lines", g["a"] + 1, g["b"] - g["a"])))
    removed = F.aggregate("struck", F.lit(0), lambda n, s: n + s["to"] - s["from"])
    left = F.when(F.col("struck").isNull(), F.col("doc.text")).otherwise(F.array_join(kept, "\n"))
    if not counts:
        return joined.select(*shared.fields(docs, text=left))
    return joined.select(
        *shared.fields(docs.drop("n_lines", "n_removed"), text=left),
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed"),
    )


def digest(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")


#: The same in DuckDB's SQL, on the windows themselves in place of their hashes.
SQL = """
WITH d AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) AS rid, string_split(text, chr(10)) AS lines FROM documents),
w AS (SELECT rid, doc_id, p - 1 AS pos, lines[p] || chr(10) || lines[p + 1] || chr(10) || lines[p + 2] AS win
      FROM (SELECT *, unnest(generate_series(1, len(lines) - 2)) AS p FROM d WHERE len(lines) >= 3)),
r AS (SELECT rid, pos, row_number() OVER (PARTITION BY win ORDER BY rid, pos) AS k FROM w WHERE regexp_matches(win, '[^\\x20\\x09-\\x0D]')),
c AS (SELECT DISTINCT rid, pos + o AS pos FROM r, (VALUES (0), (1), (2)) AS v(o) WHERE k > 1),
l AS (SELECT rid, p - 1 AS pos, lines[p] AS line FROM (SELECT rid, lines, unnest(generate_series(1, len(lines))) AS p FROM d)),
k AS (SELECT l.rid, string_agg(l.line, chr(10) ORDER BY l.pos) AS left_text, count(*) AS n_left
      FROM l LEFT JOIN c ON l.rid = c.rid AND l.pos = c.pos WHERE c.rid IS NULL GROUP BY l.rid)
SELECT d.doc_id, coalesce(len(d.lines), 0)::BIGINT AS n_lines, coalesce(len(d.lines) - coalesce(k.n_left, 0), 0)::BIGINT AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.left_text, '') END AS text
FROM d LEFT JOIN k ON d.rid = k.rid
"""
