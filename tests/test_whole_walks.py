"""Queries over walks against their SQL, on tables where nodes have many occurrences."""

import duckdb
import pytest

import __spark_entry__ as e

TABLES = {
    "part": ("p_partkey long, p_size int", [(p, 30 + p) for p in range(1, 6)]),
    "orders": ("o_orderkey long, o_custkey long", [(o, o % 9) for o in range(100, 150)]),
    # Every order has parts 1 and 2 one way and 3 the other; some have one of them again, or another order of them.
    "lineitem": ("l_orderkey long, l_linenumber int, l_partkey long, l_returnflag string", [
        (o, i, p, f) for o in range(100, 150)
        for i, (p, f) in enumerate([(1, "N"), (2, "N"), (3, "R"), *([(1, "N")] if o % 4 == 0 else []), *([(5, "N"), (4, "A")] if o % 5 == 0 else [(4, "R")])][:: 1 if o % 7 else -1], 1)]),
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("walks")
    for name, (schema, rows) in TABLES.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{at}/{name}.parquet")
    return str(at)


def compared(spark, folder, name):
    """Rows of a query and of its SQL, in one order."""
    with duckdb.connect() as con:
        for table in TABLES:
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
        said = con.execute(e.oracle_sql()[name])
        names = [c[0] for c in said.description]
        wanted = sorted(said.fetchall())
    got = e.queries()[name](spark, folder)
    assert sorted(got.columns) == sorted(names)
    return sorted(map(tuple, got.select(*names).collect())), wanted


def test_nodes_of_many_occurrences_place_every_two_paths(spark, folder):
    """Every two orders share the nodes of part 1, which occur 50 times and more."""
    got, wanted = compared(spark, folder, "linear_ends")
    assert got == wanted
    assert len({r[:2] for r in got}) == 50 * 49


def test_nodes_of_many_occurrences_are_in_longest_matches(spark, folder):
    """Order 101 has the parts of many others in their order, so its one match is its whole walk."""
    got, wanted = compared(spark, folder, "matches_pruned")
    assert got == wanted
    steps = e.queries()["syncmer_walks"](spark, folder).where("path_id = 101").count()
    assert [r for r in got if r[0] == 101] == [(101, 0, steps)]


def test_nodes_of_many_occurrences_count_as_hits(spark, folder):
    """Every two orders share the nodes of part 1."""
    got, wanted = compared(spark, folder, "read_hits")
    assert got == wanted
    assert len(got) == 50 * 50
