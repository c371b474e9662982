"""Interval algebra on half-open ranges, as joins and windows.

Tables have a key (one or more columns) and two bounds.  Overlap joins deal both sides into bins and keep
a pair only in the later of the two first bins, so no pair needs a ``distinct``; the equi-join on (key, bin)
shuffles like any other and a dense sequence spreads over its bins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN = 4096


def _binned(df: DataFrame, start: str, stop: str, width: int, name: str) -> DataFrame:
    low = F.floor(F.col(start) / width).cast("long")
    high = F.floor((F.greatest(F.col(stop), F.col(start) + 1) - 1) / width).cast("long")
    return df.withColumn(f"{name}_first", low).withColumn("_bin", F.explode(F.sequence(low, high)))


def overlap_join(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], left_range: tuple[str, str], right_range: tuple[str, str], how: str = "inner", width: int = BIN) -> DataFrame:
    """Rows whose keys are equal and whose ranges share a base.  ``how``: inner, left_semi or left_anti.

    ``keys`` pairs left and right columns; all columns of both sides must differ in name.
    """
    a, b = _binned(left, *left_range, width, "_l"), _binned(right, *right_range, width, "_r")
    b = b.withColumnRenamed("_bin", "_bin_r")
    match = (a["_bin"] == b["_bin_r"]) & (F.col(left_range[0]) < F.col(right_range[1])) & (F.col(right_range[0]) < F.col(left_range[1]))
    for x, y in keys:
        match &= a[x] == b[y]
    if how == "inner":
        return a.join(b, match & (F.col("_bin") == F.greatest("_l_first", "_r_first"))).drop("_bin", "_bin_r", "_l_first", "_r_first")
    # A row of many bins is kept or not as a whole.
    named = left.withColumn("_row", F.struct(*left.columns))
    hit = overlap_join(named, right, keys, left_range, right_range, "inner", width).select("_row").distinct().withColumnRenamed("_row", "_hit")
    return named.join(hit, F.col("_row").eqNullSafe(F.col("_hit")), how).drop("_row")


#: Coordinates of a stretch: windows run within a key's stretches first, and what a stretch takes over from those before it is one row.
STRETCH = 1 << 16


def _stretched(df: DataFrame, at: str) -> DataFrame:
    return df.withColumn("_stretch", F.floor(F.col(at) / STRETCH).cast("long"))


def _joined(df: DataFrame, keys: Sequence[str], start: str, stop: str, distance: int, n: Column, extra: Sequence[Column] = ()) -> DataFrame:
    """Ranges of a key joined, in one window of the key."""
    order = Window.partitionBy(*keys).orderBy(start, stop)
    reach = F.max(stop).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col(start) <= reach + distance, 0).otherwise(1)
    grouped = df.withColumn("_fresh", fresh).withColumn("_run", F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*keys, "_run").agg(F.min(start).alias(start), F.max(stop).alias(stop), n.alias("n_merged"), *extra).drop("_run")


def merge(df: DataFrame, keys: Sequence[str], start: str, stop: str, distance: int = 0, extra: Sequence[Column] = ()) -> DataFrame:
    """Ranges of a key joined where the next starts within ``distance`` of all before (inclusive); a negative distance joins none.

    Ranges are joined within a key's stretches first, so that a sequence's many ranges spread over tasks; what is left of them, disjoint
    runs, is then joined by key.  ``extra`` are aggregates over each merged range (of keys that are finer than sequences: these are one
    window each); ``n_merged`` counts its members.
    """
    if distance < 0:
        numbered = df.withColumn("_run", F.monotonically_increasing_id())
        return numbered.groupBy(*keys, "_run").agg(F.min(start).alias(start), F.max(stop).alias(stop), F.count("*").alias("n_merged"), *extra).drop("_run")
    if extra:
        return _joined(df, keys, start, stop, distance, F.count("*"), extra)
    near = _joined(_stretched(df.select(*keys, start, stop), start), [*keys, "_stretch"], start, stop, distance, F.count("*"))
    return _joined(near.drop("_stretch"), keys, start, stop, distance, F.sum("n_merged"))


def _carried(dealt: DataFrame, keys: Sequence[str], totals: Sequence[Column], window: Sequence[Column]) -> DataFrame:
    """``dealt`` with columns over the totals of each key's stretches: a row for each stretch, joined back to its rows."""
    names = [*keys, "_stretch"]
    per = dealt.groupBy(*names).agg(*totals)
    held = per.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(names)), *window)
    match = F.lit(True)
    for i, k in enumerate(names):
        match &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return dealt.join(held, match).drop(*(f"_k{i}" for i in range(len(names))))


def sweep(edges: DataFrame, keys: Sequence[str], start: str, stop: str, depths: Sequence[str]) -> DataFrame:
    """Pieces between neighbouring bounds of a key (one row for each bound, ``at``) with the sums of the depths' changes up to each."""
    dealt = _stretched(edges, "at").repartition(*keys, "_stretch")
    order = Window.partitionBy(*keys).orderBy("_stretch")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    # A stretch's last bound ends at the first bound of the key's next stretch.
    carried = _carried(
        dealt, keys, [F.min("at").alias("_first"), *(F.sum(d).alias(f"_t{d}") for d in depths)],
        [F.lead("_first").over(order).alias("_next"), *(F.coalesce(F.sum(f"_t{d}").over(earlier), F.lit(0)).alias(f"_b{d}") for d in depths)],
    )
    own = Window.partitionBy(*keys, "_stretch").orderBy("at")
    pieces = carried.select(*keys, F.col("at").alias(start), F.coalesce(F.lead("at").over(own), F.col("_next")).alias(stop), *((F.col(f"_b{d}") + F.sum(d).over(own)).alias(d) for d in depths))
    return pieces.where(F.col(stop).isNotNull())


def subtract(left: DataFrame, right: DataFrame, keys: Sequence[str], start: str, stop: str, width: int = BIN) -> DataFrame:
    """The parts of merged ``left`` ranges that no ``right`` range covers: keys, start, stop.

    A sweep over the bounds of both sides: depth of each side between neighbouring bounds.
    """
    def edges(df: DataFrame, mine: int) -> DataFrame:
        ends = F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("d")), F.struct(F.col(stop).alias("at"), F.lit(-1).alias("d"))))
        return df.where(F.col(start) < F.col(stop)).select(*keys, ends.alias("e")).select(*keys, F.col("e.at").alias("at"), (F.col("e.d") * mine).alias("dl"), (F.col("e.d") * (1 - mine)).alias("dr"))

    both = edges(left, 1).unionByName(edges(right, 0)).groupBy(*keys, "at").agg(F.sum("dl").alias("dl"), F.sum("dr").alias("dr"))
    depth = sweep(both, keys, start, stop, ("dl", "dr"))
    return merge(depth.where("dl > 0 and dr = 0").select(*keys, start, stop), keys, start, stop).select(*keys, start, stop)


def intersect(left: DataFrame, right: DataFrame, keys: Sequence[str], start: str, stop: str, width: int = BIN) -> DataFrame:
    """Each overlap of a left and a right range: keys, start, stop."""
    r = right.select(*(F.col(k).alias(f"_r_{k}") for k in keys), F.col(start).alias("_r_start"), F.col(stop).alias("_r_stop"))
    both = overlap_join(left, r, [(k, f"_r_{k}") for k in keys], (start, stop), ("_r_start", "_r_stop"), width=width)
    return both.select(*keys, F.greatest(start, "_r_start").alias(start), F.least(stop, "_r_stop").alias(stop))


def complement(df: DataFrame, seqs: DataFrame, key: str, start: str, stop: str, length: str = "length") -> DataFrame:
    """What the ranges leave of each sequence."""
    whole = seqs.select(key, F.lit(0).cast("int").alias(start), F.col(length).cast("int").alias(stop))
    return subtract(whole, df, [key], start, stop)


def tile(df: DataFrame, start: str, stop: str, size: int, fold_tail: bool = False) -> DataFrame:
    """Windows of ``size`` along each range; a short last one stays, or is folded into the one before."""
    n = F.greatest(F.lit(1), F.floor((F.col(stop) - F.col(start)) / size) if fold_tail else F.ceil((F.col(stop) - F.col(start)) / size))
    numbered = df.where(F.col(start) < F.col(stop)).withColumn("_n", n.cast("int")).withColumn("window", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    begin = F.col(start) + F.col("window") * size
    end = F.when(F.col("window") == F.col("_n") - 1, F.col(stop)).otherwise(begin + size)
    return numbered.withColumn("_b", begin).withColumn("_e", end).drop(start, stop, "_n").withColumnsRenamed({"_b": start, "_e": stop})


def snap_to_ends(df: DataFrame, start: str, stop: str, length: str, within: int) -> DataFrame:
    """Ranges nearer than ``within`` to an end of their sequence reach it."""
    return df.withColumns({start: F.when(F.col(start) < within, 0).otherwise(F.col(start)), stop: F.when(F.col(length) - F.col(stop) < within, F.col(length)).otherwise(F.col(stop))})


def insert(seen: DataFrame, new: DataFrame, keys: Sequence[str], start: str, stop: str) -> tuple[DataFrame, DataFrame]:
    """The pieces of ``new`` that ``seen`` doesn't cover, and both merged."""
    fresh = subtract(new, seen, keys, start, stop)
    return fresh, merge(seen.select(*keys, start, stop).unionByName(fresh), keys, start, stop).select(*keys, start, stop)


def depth_runs(df: DataFrame, keys: Sequence[str], start: str, stop: str) -> DataFrame:
    """Maximal runs of equal coverage: keys, start, stop, depth."""
    ends = df.where(F.col(start) < F.col(stop)).select(*keys, F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("d")), F.struct(F.col(stop).alias("at"), F.lit(-1).alias("d")))).alias("e"))
    steps = ends.groupBy(*keys, F.col("e.at").alias("at")).agg(F.sum("e.d").alias("depth")).where("depth <> 0")
    return sweep(steps, keys, start, stop, ("depth",)).where("depth > 0")


def contained_dropped(df: DataFrame, keys: Sequence[str], start: str, stop: str) -> DataFrame:
    """Ranges that no other range of their key contains; of equal ranges one stays."""
    dealt = _stretched(df, start).repartition(*keys, "_stretch")
    earlier = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = _carried(dealt, keys, [F.max(stop).alias("_m")], [F.max("_m").over(earlier).alias("_before")])
    own = Window.partitionBy(*keys, "_stretch").orderBy(F.col(start), F.col(stop).desc()).rowsBetween(Window.unboundedPreceding, -1)
    reached = carried.withColumn("_reach", F.greatest("_before", F.max(stop).over(own)))
    return reached.where(F.col("_reach").isNull() | (F.col(stop) > F.col("_reach"))).drop("_reach", "_before", "_stretch")


def covers(start: Column, stop: Column, r_start: Column, r_end: Column, span: int) -> Column:
    """Whether a range reaches both ends of another, to ``span`` bases inside it."""
    return (start <= r_start + F.least(F.lit(span), r_end - r_start)) & (stop >= r_end - F.least(F.lit(span), r_end - r_start)) & (start < stop)


def merge_either(df: DataFrame, keys: Sequence[str], a: tuple[str, str], b: tuple[str, str], distance: int) -> DataFrame:
    """Paired ranges joined one after another where they follow within ``distance`` on either side; ``n_merged`` counts them.

    The order is that of both ranges; each range is compared with what has been joined so far, so this is a
    fold over a key's ranges inside one row (of a key, not of the table).
    """
    kind = "struct<" + ",".join(f"{c}:bigint" for c in ("a0", "a1", "b0", "b1", "n")) + ">"
    item = F.struct(F.col(a[0]).cast("long").alias("a0"), F.col(a[1]).cast("long").alias("a1"), F.col(b[0]).cast("long").alias("b0"), F.col(b[1]).cast("long").alias("b1"), F.lit(1).cast("long").alias("n"))

    def near(x: Column, y: Column, s: str) -> Column:
        return F.least(F.abs(y[f"{s}0"] - x[f"{s}1"]), F.abs(x[f"{s}0"] - y[f"{s}1"])) <= distance

    def add(done: Column, y: Column) -> Column:
        x = F.element_at(done, -1)
        joined = F.struct(*(f(x[c], y[c]).alias(c) for c, f in (("a0", F.least), ("a1", F.greatest), ("b0", F.least), ("b1", F.greatest))), (x["n"] + y["n"]).alias("n"))
        return F.when((F.size(done) > 0) & (near(x, y, "a") | near(x, y, "b")), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(y)))

    folded = df.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_all")).select(*keys, F.explode(F.aggregate("_all", F.array().cast(f"array<{kind}>"), add)).alias("m"))
    return folded.select(*keys, F.col("m.a0").alias(a[0]), F.col("m.a1").alias(a[1]), F.col("m.b0").alias(b[0]), F.col("m.b1").alias(b[1]), F.col("m.n").alias("n_merged"))
