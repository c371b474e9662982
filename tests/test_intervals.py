"""Interval algebra against plain sets of positions."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from loomspan.operators import intervals

ranges = st.lists(st.tuples(st.integers(0, 1), st.integers(0, 60), st.integers(1, 15)), max_size=12).map(lambda xs: [(k, a, a + n) for k, a, n in xs])
few = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
SCHEMA = "k int, s int, e int"


def positions(rows):
    return {(k, p) for k, a, b in rows for p in range(a, b)}


@few
@given(ranges, ranges)
def test_subtract_and_insert(spark, left, right):
    a, b = spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA)
    rest = [tuple(r) for r in intervals.subtract(a, b, ["k"], "s", "e").collect()]
    assert positions(rest) == positions(left) - positions(right)
    fresh, seen = intervals.insert(b, a, ["k"], "s", "e")
    assert positions(map(tuple, fresh.collect())) == positions(left) - positions(right)
    merged = [tuple(r) for r in seen.collect()]
    assert positions(merged) == positions(left) | positions(right)
    for k in (0, 1):
        own = sorted(r for r in merged if r[0] == k)
        assert all(x[2] < y[1] for x, y in zip(own, own[1:]))


@few
@given(ranges, st.integers(0, 5))
def test_merge_is_idempotent(spark, rows, d):
    once = intervals.merge(spark.createDataFrame(rows, SCHEMA), ["k"], "s", "e", d).select("k", "s", "e")
    twice = intervals.merge(once, ["k"], "s", "e", d).select("k", "s", "e")
    assert sorted(once.collect()) == sorted(twice.collect())


@few
@given(ranges, ranges, st.sampled_from([3, 16, 4096]))
def test_overlap_join_is_every_pair_once(spark, left, right, width):
    a = spark.createDataFrame([(i, *r) for i, r in enumerate(left)], "i int, k int, s int, e int")
    b = spark.createDataFrame([(i, *r) for i, r in enumerate(right)], "j int, k2 int, s2 int, e2 int")
    got = sorted((r["i"], r["j"]) for r in intervals.overlap_join(a, b, [("k", "k2")], ("s", "e"), ("s2", "e2"), width=width).collect())
    assert got == sorted((i, j) for i, x in enumerate(left) for j, y in enumerate(right) if x[0] == y[0] and x[1] < y[2] and y[1] < x[2])
    for how in ("left_semi", "left_anti"):
        kept = {r["i"] for r in intervals.overlap_join(a, b, [("k", "k2")], ("s", "e"), ("s2", "e2"), how, width).collect()}
        met = {i for i, _ in got}
        assert kept == (met if how == "left_semi" else set(range(len(left))) - met)


def test_tile_folds_short_tail(spark):
    df = spark.createDataFrame([(0, 0, 250), (1, 5, 30)], SCHEMA)
    assert sorted((r["k"], r["s"], r["e"]) for r in intervals.tile(df, "s", "e", 100, True).collect()) == [(0, 0, 100), (0, 100, 250), (1, 5, 30)]
    assert sorted((r["s"], r["e"]) for r in intervals.tile(df.where("k = 0"), "s", "e", 100).collect()) == [(0, 100), (100, 200), (200, 250)]


def test_merge_either_side(spark):
    rows = [(1, 0, 10, 100, 110), (1, 12, 20, 500, 510), (1, 900, 910, 512, 520), (1, 2000, 2010, 5000, 5010), (2, 0, 5, 0, 5)]
    df = spark.createDataFrame(rows, "k int, qs int, qe int, ts int, te int")
    got = sorted(tuple(r) for r in intervals.merge_either(df, ["k"], ("qs", "qe"), ("ts", "te"), 3).collect())
    assert got == [(1, 0, 910, 100, 520, 3), (1, 2000, 2010, 5000, 5010, 1), (2, 0, 5, 0, 5, 1)]
