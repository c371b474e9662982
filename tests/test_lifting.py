"""Lifting in batches against the fold over each row, and what its plans leave out."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomspan.operators import cigar, intervals, lifting, projection


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(5)
    aln = []
    for i in range(400):
        ops = [(rng.choice([0, 1, 2, 5, 12, 40]), rng.choice("=XMID")) for _ in range(rng.randint(0, 7))]
        t, q = (sum(n for n, o in ops if o not in no) for no in ("I", "D"))
        ts, qs = rng.randint(0, 40_000), rng.randint(0, 500)
        # Some have bounds that their operations don't bear out.
        aln.append((i, rng.choice("xyz"), qs, qs + q + rng.choice([0, 0, 0, 3]), rng.choice("ab"), ts, ts + t + rng.choice([0, 0, 0, 4, -2]), rng.choice("+-"), ops))
    regions = [(i, rng.choice("ab"), s, s + rng.choice([0, 1, 30, 400, 20_000])) for i in range(120) for s in [rng.randint(0, 40_000)]]
    regions += [(200 + i, t, max(0, s + rng.randint(-3, 3)), e + rng.randint(-3, 3)) for i, (_, _, _, _, t, s, e, _, _) in enumerate(aln[:60])]
    return (spark.createDataFrame(aln, "aln_id int, query_id string, qs int, qe int, target_id string, ts int, te int, strand string, cigar array<struct<len:int,op:string>>"),
            spark.createDataFrame(regions, "region_id int, seq_id string, r_start int, r_end int").where("r_start <= r_end"))


def rows(df):
    return Counter(map(tuple, df.collect()))


def test_hits_and_counts_are_those_of_the_fold(tables):
    found, regions = tables
    r = regions.withColumnRenamed("seq_id", "_seq")
    s = cigar.stats(F.col("cigar"))
    hit = projection._with_cigars(r, found, None, ("region_id",), intervals.BIN).withColumn("s", projection.once(s)).select(
        "region_id", "query_id", "q_first", "q_last", "target_id", "t_first", "t_last", *(f"s.{c}" for c in lifting.STATS))
    wanted = rows(hit)
    assert len(wanted) > 500
    assert rows(projection.query(regions, found, with_self=False, with_stats=True)) == wanted
    exact = rows(projection._with_cigars(r, found, 0.8, ("region_id",), intervals.BIN).where("abs(q_last - q_first) >= 5").drop("cigar"))
    assert rows(projection.query(regions, found, min_identity=0.8, min_length=5, with_self=False)) == exact


@pytest.mark.parametrize("by_strand", [False, True])
@pytest.mark.parametrize("distance", [0, 60])
def test_hits_joined_where_they_are_found(tables, distance, by_strand, monkeypatch):
    found, regions = tables
    monkeypatch.setattr(lifting, "CHUNK", 50)
    own = projection.query_merged(regions, found, distance, by_strand)
    assert rows(own) == rows(projection.merged(projection.query(regions, found), distance, by_strand=by_strand).select(*own.columns))
    twice = regions.unionByName(regions.withColumn("r_start", F.greatest(F.lit(0), F.col("r_start") - 7)))  # a region of two ranges
    assert rows(projection.query_merged(twice, found, distance, by_strand).select(*own.columns)) == rows(projection.merged(projection.query(twice, found), distance, by_strand=by_strand).select(*own.columns))


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("what", ["hits", "identity", "paf", "joined", "approximate"])
def test_hits_are_folded_in_batches_and_not_shuffled(tables, what):
    """A fold over each hit, or a shuffle of all hits, is what took hours at 1 GB."""
    found, regions = tables
    traced = found.withColumn("trace", projection.tracepoints(F.col("cigar"), 50))
    df = {"hits": lambda: projection.query(regions, found), "identity": lambda: projection.query(regions, found, min_identity=0.9, with_self=False), "paf": lambda: projection.query(regions, found, with_stats=True),
          "joined": lambda: projection.query_merged(regions, found, 10), "approximate": lambda: projection.approximate(regions, traced)}[what]()
    above = plan(df).split("MapInArrow")[0]
    assert "MapInArrow" in plan(df) and "aggregate(" not in above and "Window" not in above and "Join" not in plan(df)


def test_chains_are_those_of_the_fold_over_a_row(spark):
    import numpy as np

    rng = np.random.default_rng(7)
    for distance in (0, 15, 100):
        who, a0, b0 = rng.integers(0, 12, 300), rng.integers(0, 900, 300), rng.integers(0, 900, 300)
        a1, b1 = a0 + rng.integers(1, 40, 300), b0 + rng.integers(1, 40, 300)
        df = spark.createDataFrame(np.stack([who, a0, a1, b0, b1], 1).tolist(), "who long, a0 long, a1 long, b0 long, b1 long")
        wanted = Counter(map(tuple, intervals.merge_either(df, ["who"], ("a0", "a1"), ("b0", "b1"), distance).select("who", "a0", "a1").collect()))
        assert Counter(zip(*(x.tolist() for x in lifting.chained(who, a0, a1, b0, b1, distance)))) == wanted
    assert [len(x) for x in lifting.chained(*(np.zeros(0, np.int64),) * 5, 3)] == [0, 0, 0]


def test_regions_are_refined_by_all_flanks(spark):
    """Flanks go to 10,000 bases, not to 400."""
    import duckdb

    import __spark_entry__ as e

    folder = "/root/testdata/sf0.001"
    with duckdb.connect() as con:
        for table in ("region", "nation", "customer", "lineitem"):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
        wanted = con.execute(e.oracle_sql()["refine_regions"]).fetchall()
    got = e.queries()["refine_regions"](spark, folder)
    assert Counter(map(tuple, got.collect())) == Counter(wanted)
    assert got.where("`left` > 400").count() and got.where("`right` > 400").count()
