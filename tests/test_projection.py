"""Goldens of the projection kernel and of small alignment graphs."""

import pytest
from pyspark.sql import functions as F

from loomspan.operators import cigar, projection

KERNEL = [
    ("100=", (100, 200, 0, 100, "+"), (100, 200), (0, 100, 100, 200), None),
    ("100=", (100, 200, 0, 100, "-"), (100, 200), (100, 0, 100, 200), None),
    ("10=5I5D50=50I35=", (0, 100, 50, 200, "+"), (0, 100), (50, 200, 0, 100), None),
    ("10=5I5D50=50I35=", (0, 100, 50, 200, "+"), (50, 55), (100, 105, 50, 55), "5="),
    ("10=5I5D50=50I35=", (0, 100, 50, 200, "+"), (50, 64), (100, 114, 50, 64), "14="),
    ("10=5I5D50=50I35=", (0, 100, 50, 200, "+"), (50, 65), (100, 165, 50, 65), "15=50I"),
    ("10=5I5D50=50I35=", (0, 100, 50, 200, "+"), (50, 66), (100, 166, 50, 66), "15=50I1="),
    ("10=5I5D50=50I35=", (0, 100, 50, 200, "+"), (70, 95), (170, 195, 70, 95), "25="),
    ("50=10D10I40=", (100, 200, 200, 300, "-"), (150, 250), (250, 200, 150, 200), "10D10I40="),
    ("10=20D8=1X1=10I10=", (0, 50, 0, 40, "+"), (0, 10), (0, 10, 0, 10), None),
    ("10D", (0, 10, 0, 0, "+"), (0, 10), None, None),
    ("10I", (5, 5, 0, 10, "+"), (0, 10), None, None),
]


def test_kernel_goldens(spark):
    rows = [(i, text, *record, *asked) for i, (text, record, asked, _, _) in enumerate(KERNEL)]
    df = spark.createDataFrame(rows, "i int, text string, ts int, te int, qs int, qe int, strand string, r_start int, r_end int").withColumn("cigar", cigar.parse(F.col("text")))
    hit = cigar.project(F.col("cigar"), *(F.col(c) for c in ("ts", "te", "qs", "qe", "strand", "r_start", "r_end")))
    found = df.withColumn("hit", projection.once(hit)).withColumn("kept", cigar.render(cigar.clipped(F.col("cigar"), F.col("hit")))).orderBy("i").collect()
    for row, (_, _, _, expected, kept) in zip(found, KERNEL):
        assert (row["hit"] and tuple(row["hit"][:4])) == expected, row
        if kept:
            assert row["kept"] == kept, row


def test_inversion_and_identity(spark):
    df = spark.createDataFrame([("10=5I3D7X", "+", "10=5D3I7X", 10 / 19), ("10=5I3D", "-", "3I5D10=", 10 / 12), ("", "+", "", 0.0), ("5M5X", "+", "5M5X", 0.5)], "c string, strand string, inv string, identity double")
    ops = cigar.parse(F.col("c"))
    for row in df.select("inv", "identity", cigar.render(cigar.invert(ops, F.col("strand"))).alias("got"), cigar.gap_compressed_identity(ops).alias("g")).collect():
        assert row["got"] == row["inv"] and row["g"] == pytest.approx(row["identity"])
    bad = spark.createDataFrame([("5S10=",)], "c string").select(cigar.parse(F.col("c"))).first()
    assert bad[0] is None


def test_compact(spark):
    df = spark.createDataFrame([("2=3=0I4X1X",)], "c string").select(cigar.render(cigar.compact(cigar.parse(F.col("c")))).alias("c"))
    assert df.first()["c"] == "5=5X"


def _world(spark, lines):
    """Alignments (query, qs, qe, target, ts, te, strand, cigar) between sequences named by letters."""
    rows = [(i, ord(q) - 65, qs, qe, ord(t) - 65, ts, te, strand, c) for i, (q, qs, qe, t, ts, te, strand, c) in enumerate(lines)]
    df = spark.createDataFrame(rows, "aln_id int, query_id int, qs int, qe int, target_id int, ts int, te int, strand string, c string")
    return projection.entries(df.withColumn("cigar", cigar.parse(F.col("c"))).drop("c"))


def _ask(spark, entries, name, start, end, **more):
    regions = spark.createDataFrame([(0, ord(name) - 65, start, end)], "region_id int, seq_id int, r_start int, r_end int")
    found = projection.transitive(regions, entries, **more) if "max_depth" in more else projection.query(regions, entries)
    return sorted((chr(65 + r["query_id"]), r["q_first"], r["q_last"]) for r in found.collect())


def test_hits_stay_apart_and_go_both_ways(spark):
    e = _world(spark, [("A", 0, 100, "B", 0, 100, "+", "100="), ("A", 500, 600, "C", 0, 100, "+", "100=")])
    assert _ask(spark, e, "A", 0, 100) == [("A", 0, 100), ("B", 0, 100)]
    assert _ask(spark, e, "A", 500, 600) == [("A", 500, 600), ("C", 0, 100)]
    assert _ask(spark, e, "B", 10, 20) == [("A", 10, 20), ("B", 10, 20)]
    assert _ask(spark, e, "A", 200, 300) == [("A", 200, 300)]


def test_reverse_strand_and_indels(spark):
    e = _world(spark, [("A", 0, 100, "B", 0, 100, "-", "100=")])
    assert ("B", 100, 50) in _ask(spark, e, "A", 0, 50)
    e = _world(spark, [("A", 0, 110, "B", 0, 100, "+", "50=10I50=")])
    assert ("B", 0, 50) in _ask(spark, e, "A", 0, 50)
    assert ("B", 50, 100) in _ask(spark, e, "A", 60, 110)


def test_depth_limits_closure(spark):
    e = _world(spark, [(q, 0, 100, t, 0, 100, "+", "100=") for q, t in ("AB", "BC", "CD")])
    names = lambda depth: {x[0] for x in _ask(spark, e, "A", 0, 100, max_depth=depth)}
    assert names(1) == {"A", "B"} and names(2) == {"A", "B", "C"} and names(0) == {"A", "B", "C", "D"}
    assert ("C", 25, 75) in _ask(spark, e, "A", 25, 75, max_depth=2)
