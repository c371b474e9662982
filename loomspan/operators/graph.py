"""Variation graphs as tables: segments (seg_id, len, seq), links (from_id, from_orient, to_id, to_orient), steps (path_id, idx, seg_id, orient).

Segment order is the order of ``seg_id``.  Positions and running totals over the whole order are found in
range-partitioned blocks, so that no task holds all segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.session import cut, lookup

#: Upper bounds of the node coverage histogram; above the last one is open.
COVERAGE_BOUNDS = (0, 1, 2, 4, 8, 16, 32, 64, 128)


def ordered(df: DataFrame, key: str, index: str = "ord", total: str | None = None, running: str = "bp_start") -> DataFrame:
    """``df`` with the rank of ``key`` from 0 and, for a ``total`` column, the sum of it over all before."""
    dealt = cut(df.repartitionByRange(key).withColumn("_part", F.spark_partition_id()))
    sums = [F.count("*").alias("_n"), *([F.sum(total).alias("_t")] if total else [])]
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("_part").agg(*sums)
    offsets = parts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), *([F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_t0")] if total else []))
    own = Window.partitionBy("_part").orderBy(key)
    out = dealt.join(F.broadcast(offsets), "_part").withColumn(index, F.col("_n0") + F.row_number().over(own) - 1)
    if total:
        out = out.withColumn(running, F.col("_t0") + F.coalesce(F.sum(total).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return out.drop("_part", "_n0", "_t0")


def label(seg: str = "seg_id", orient: str = "orient") -> Column:
    return F.concat(F.col(seg).cast("string"), F.col(orient))


def neighbours(steps: DataFrame) -> DataFrame:
    """Each step with the one after it on its path: path_id, idx, a, a_orient, b, b_orient."""
    order = Window.partitionBy("path_id").orderBy("idx")
    return steps.select("path_id", "idx", F.col("seg_id").alias("a"), F.col("orient").alias("a_orient"), F.lead("seg_id").over(order).alias("b"), F.lead("orient").over(order).alias("b_orient")).where("b is not null")


def node_coverage(segments: DataFrame, steps: DataFrame) -> DataFrame:
    """visits, distinct paths and the most visits by one path of every segment."""
    per_path = steps.groupBy("seg_id", "path_id").agg(F.count("*").alias("n"))
    seen = per_path.groupBy("seg_id").agg(F.sum("n").alias("visits"), F.count("*").alias("paths"), F.max("n").alias("most"))
    return segments.select("seg_id", "len").join(seen, "seg_id", "left").fillna(0, ["visits", "paths", "most"])


def nearest_rank(column: str, fraction: float) -> Column:
    return F.expr(f"percentile_disc({fraction}) within group (order by {column})")


def coverage_histogram(coverage: DataFrame) -> DataFrame:
    """Segments and bases of each range of visits."""
    low, bucket = -1, F.lit(None).cast("string")
    for high in reversed(COVERAGE_BOUNDS):
        at = COVERAGE_BOUNDS.index(high)
        low = COVERAGE_BOUNDS[at - 1] + 1 if at else 0
        bucket = F.when(F.col("visits") <= high, str(high) if low == high else f"{low}-{high}").otherwise(bucket) if high != COVERAGE_BOUNDS[-1] else F.when(F.col("visits") <= high, f"{low}-{high}").otherwise(f"{high + 1}+")
    return coverage.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("nodes"), F.sum("len").alias("bp"))


def gaps(segments: DataFrame, steps: DataFrame) -> DataFrame:
    """Neighbouring steps with the jump in order and the bases of layout between them: path_id, idx, a, b, jump, gap_bp, gap_start, gap_end."""
    laid = ordered(segments.select("seg_id", "len"), "seg_id", total="len")
    x, y = (laid.select(F.col("seg_id").alias(k), F.col("ord").alias(f"{k}_ord"), F.col("bp_start").alias(f"{k}_start"), (F.col("bp_start") + F.col("len")).alias(f"{k}_end")) for k in ("a", "b"))
    both = neighbours(steps).join(x, "a").join(y, "b")
    ahead, back = F.col("a_end") <= F.col("b_start"), F.col("b_end") <= F.col("a_start")
    start = F.when(ahead, F.col("a_end")).when(back, F.col("b_end")).otherwise(F.least("a_start", "b_start"))
    end = F.when(ahead, F.col("b_start")).when(back, F.col("a_start")).otherwise(F.greatest("a_end", "b_end"))
    return both.select("path_id", "idx", "a", "b", F.abs(F.col("a_ord") - F.col("b_ord")).alias("jump"), F.when(ahead | back, end - start).otherwise(0).alias("gap_bp"), start.alias("gap_start"), end.alias("gap_end"))


def white_space_regions(found: DataFrame, least_gap: int, least_support: int) -> DataFrame:
    """Stretches of layout that at least ``least_support`` neighbouring steps jump over: start_bp, end_bp, crossing."""
    wide = found.where((F.col("gap_bp") >= least_gap) & (F.col("gap_start") < F.col("gap_end")))
    edges = wide.select(F.explode(F.array(F.struct(F.col("gap_start").alias("at"), F.lit(1).alias("d")), F.struct(F.col("gap_end").alias("at"), F.lit(-1).alias("d")))).alias("e")).groupBy(F.col("e.at").alias("start_bp")).agg(F.sum("e.d").alias("d"))
    order = Window.orderBy("start_bp")
    return edges.select("start_bp", F.lead("start_bp").over(order).alias("end_bp"), F.sum("d").over(order).alias("crossing")).where(f"end_bp is not null and crossing >= {least_support}")


def components(segments: DataFrame, links: DataFrame) -> DataFrame:
    """seg_id and comp, the least segment of its undirected component: least labels with pointer jumping."""
    both = links.select(F.col("from_id").alias("a"), F.col("to_id").alias("b"))
    edges = cut(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = cut(segments.select("seg_id", F.col("seg_id").alias("comp")))
    while True:
        near = edges.join(labels, edges["b"] == labels["seg_id"]).groupBy("a").agg(F.min("comp").alias("_near"))
        met = labels.join(near, labels["seg_id"] == near["a"], "left").select("seg_id", F.least("comp", F.coalesce("_near", "comp")).alias("comp"), F.col("comp").alias("_was"))
        ahead = labels.select(F.col("seg_id").alias("_v"), F.col("comp").alias("_ahead"))
        new = cut(met.join(ahead, F.col("comp") == F.col("_v")).select("seg_id", F.least("comp", "_ahead").alias("comp"), "_was"))
        labels = new.select("seg_id", "comp")
        if new.where("comp <> _was").isEmpty():
            return labels


def tips(segments: DataFrame, links: DataFrame, steps: DataFrame) -> DataFrame:
    """Segments with at most one link end, and whether no path starts or ends there."""
    degree = links.select(F.explode(F.array("from_id", "to_id")).alias("seg_id")).groupBy("seg_id").agg(F.count("*").alias("degree"))
    order = Window.partitionBy("path_id").orderBy("idx")
    ends = steps.withColumns({"_first": F.lag("idx").over(order), "_last": F.lead("idx").over(order)}).where("_first is null or _last is null").select(label().alias("end_label")).distinct()
    marked = segments.select("seg_id").join(degree, "seg_id", "left").where("coalesce(degree, 0) <= 1")
    named = ends.select(F.regexp_replace("end_label", "[+-]$", "").cast("bigint").alias("_end")).distinct()
    return marked.join(named, F.col("seg_id") == F.col("_end"), "left").select("seg_id", F.col("_end").isNull().alias("internal"))


def repeat_contexts(steps: DataFrame, max_minor: int = 2, min_dominance: float = 0.8) -> DataFrame:
    """Oriented nodes nearly always met between the same neighbours, with the few exceptions counted."""
    order = Window.partitionBy("path_id").orderBy("idx")
    own = label()
    met = steps.select(own.alias("node"), F.coalesce(F.lag(own).over(order), F.lit("^")).alias("left"), F.coalesce(F.lead(own).over(order), F.lit("$")).alias("right")).groupBy("node", "left", "right").agg(F.count("*").alias("n"))
    ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("n"), "left", "right")))
    whole = ranked.groupBy("node").agg(
        F.sum("n").alias("total"), F.max(F.when(F.col("rank") == 1, F.col("n"))).alias("dominant"), F.max(F.when(F.col("rank") == 2, F.col("n"))).alias("_second"),
        F.max(F.when(F.col("rank") == 1, F.col("left"))).alias("dominant_left"), F.max(F.when(F.col("rank") == 1, F.col("right"))).alias("dominant_right"),
    )
    kept = whole.where((F.col("_second").isNotNull()) & (F.col("_second") < F.col("dominant")) & (F.col("total") - F.col("dominant") <= max_minor) & (F.col("dominant") / F.col("total") >= min_dominance))
    return kept.select("node", "total", "dominant", (F.col("total") - F.col("dominant")).alias("minor"), "dominant_left", "dominant_right")


def repeat_runs(steps: DataFrame) -> DataFrame:
    """Runs of two or more equal oriented steps: path_id, seg_id, orient, start_idx, run."""
    order = Window.partitionBy("path_id").orderBy("idx")
    fresh = (F.lag("seg_id").over(order).eqNullSafe(F.col("seg_id")) & F.lag("orient").over(order).eqNullSafe(F.col("orient")))
    runs = steps.withColumn("_new", F.when(fresh, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(order))
    return runs.groupBy("path_id", "_run", "seg_id", "orient").agg(F.min("idx").alias("start_idx"), F.count("*").alias("run")).where("run > 1").drop("_run")


def normalize_self_loops(segments: DataFrame, links: DataFrame, steps: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Runs of one looped node become single steps on a run node that spells the whole run; path spellings stay."""
    looped = links.where("from_id = to_id and from_orient = to_orient").select("from_id").distinct()
    order = Window.partitionBy("path_id").orderBy("idx")
    same = F.lag("seg_id").over(order).eqNullSafe(F.col("seg_id")) & F.lag("orient").over(order).eqNullSafe(F.col("orient"))
    grouped = steps.withColumn("_new", F.when(same, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(order)).groupBy("path_id", "_run", "seg_id", "orient").agg(F.min("idx").alias("idx"), F.count("*").alias("run"))
    marked = grouped.join(lookup(looped), F.col("seg_id") == F.col("from_id"), "left")
    joined = (F.col("run") > 1) & F.col("from_id").isNotNull()
    name = F.when(joined, F.concat(F.col("seg_id").cast("string"), F.lit("x"), F.col("run").cast("string"))).otherwise(F.col("seg_id").cast("string"))
    split = marked.withColumn("seg", name).withColumn("_k", F.explode(F.sequence(F.lit(1), F.when(joined, 1).otherwise(F.col("run")).cast("int"))))
    new_order = Window.partitionBy("path_id").orderBy("idx", "_k")
    new_steps = split.select("path_id", (F.row_number().over(new_order) - 1).alias("idx"), F.col("seg").alias("seg_id"), "orient", F.when(joined, F.col("run")).otherwise(1).alias("run"), F.col("seg_id").alias("source_id"))
    used = new_steps.where("run > 1").select("seg_id", "source_id", "run").distinct()
    runs = used.join(segments.withColumnRenamed("seg_id", "_s"), F.col("source_id") == F.col("_s")).select("seg_id", (F.col("len") * F.col("run")).cast("int").alias("len"), F.expr("repeat(seq, cast(run as int))").alias("seq"))
    new_segments = segments.select(F.col("seg_id").cast("string").alias("seg_id"), "len", "seq").unionByName(runs)
    new_links = neighbours(new_steps).select(F.col("a").alias("from_id"), F.col("a_orient").alias("from_orient"), F.col("b").alias("to_id"), F.col("b_orient").alias("to_orient")).distinct()
    return new_segments, new_links, new_steps.select("path_id", "idx", "seg_id", "orient")


def spellings(segments: DataFrame, steps: DataFrame) -> DataFrame:
    """path_id and the sequence that its steps spell."""
    from loomspan.functions.sequences import reverse_complement

    read = steps.join(segments.select("seg_id", "seq"), "seg_id").select("path_id", F.struct("idx", F.when(F.col("orient") == "-", reverse_complement(F.col("seq"))).otherwise(F.col("seq")).alias("s")).alias("p"))
    return read.groupBy("path_id").agg(F.array_sort(F.collect_list("p")).alias("p")).select("path_id", F.array_join(F.transform("p", lambda x: x["s"]), "").alias("spelling"))


def path_positions(segments: DataFrame, steps: DataFrame) -> DataFrame:
    """Each step's [start, end) on its path; ``overlap``, if steps have it, says how many bases one shares with the step before."""
    order = Window.partitionBy("path_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    own = F.col("len") - F.coalesce("overlap", F.lit(0)) if "overlap" in steps.columns else F.col("len")
    placed = steps.join(segments.select("seg_id", "len"), "seg_id").withColumn("end", F.sum(own).over(order))
    return placed.select("path_id", "idx", "seg_id", "orient", (F.col("end") - F.col("len")).alias("start"), "end")


def chop(segments: DataFrame, most: int) -> DataFrame:
    """Segments cut to pieces of at most ``most`` bases: seg_id, piece, len, seq."""
    pieces = segments.withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("len") / most).cast("int") - 1))))
    return pieces.select("seg_id", "piece", F.least(F.lit(most), F.col("len") - F.col("piece") * most).cast("int").alias("len"), F.substr("seq", F.col("piece") * most + 1, F.lit(most)).alias("seq"))


def chopped(segments: DataFrame, steps: DataFrame, most: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The graph with segments of at most ``most`` bases, pieces named ``segment.piece``, links and steps led through them."""
    pieces = chop(segments, most)
    name = F.concat(F.col("seg_id").cast("string"), F.lit("."), F.col("piece").cast("string"))
    n = F.greatest(F.lit(1), F.ceil(F.col("len") / most).cast("int"))
    each = steps.join(segments.select("seg_id", n.alias("_n")), "seg_id").withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    piece = F.when(F.col("orient") == "-", F.col("_n") - 1 - F.col("_k")).otherwise(F.col("_k"))
    order = Window.partitionBy("path_id").orderBy("idx", "_k")
    walked = each.select("path_id", (F.row_number().over(order) - 1).alias("_i"), F.concat(F.col("seg_id").cast("string"), F.lit("."), piece.cast("string")).alias("seg_id"), "orient").withColumnRenamed("_i", "idx")
    links = neighbours(walked).select(F.col("a").alias("from_id"), F.col("a_orient").alias("from_orient"), F.col("b").alias("to_id"), F.col("b_orient").alias("to_orient")).distinct()
    return pieces.select(name.alias("seg_id"), "len", "seq"), links, walked


def top_links(segments: DataFrame, links: DataFrame, n: int) -> DataFrame:
    """The ``n`` links that jump furthest in segment order: from_id, to_id, jump, rank."""
    laid = ordered(segments.select("seg_id"), "seg_id")
    a, b = (laid.select(F.col("seg_id").alias(f"_{k}"), F.col("ord").alias(f"_o{k}")) for k in "ab")
    met = links.select("from_id", "to_id").distinct().join(a, F.col("from_id") == F.col("_a")).join(b, F.col("to_id") == F.col("_b"))
    top = met.select("from_id", "to_id", F.abs(F.col("_oa") - F.col("_ob")).alias("jump")).orderBy(F.desc("jump"), "from_id", "to_id").limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("jump"), "from_id", "to_id")))


def top_depth(segments: DataFrame, steps: DataFrame, n: int) -> DataFrame:
    """The ``n`` segments with most visits: seg_id, len, visits, paths, rank."""
    top = node_coverage(segments, steps).orderBy(F.desc("visits"), "seg_id").limit(n)
    return top.select("seg_id", "len", "visits", "paths", F.row_number().over(Window.orderBy(F.desc("visits"), "seg_id")).alias("rank"))


def top_white_space(found: DataFrame, n: int) -> DataFrame:
    """The ``n`` neighbouring steps with most layout between them, of ``gaps``: path_id, idx, a, b, gap_bp, rank."""
    order = [F.desc("gap_bp"), F.asc("path_id"), F.asc("idx")]
    top = found.select("path_id", "idx", "a", "b", "gap_bp").orderBy(*order).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def node_spectrum(walk: DataFrame, node: str = "kmer") -> DataFrame:
    """Of each node: occurrences, carriers (paths that have it), the most that one path has, and the widest distance between two on one path."""
    per_path = walk.groupBy(node, "path_id").agg(F.count("*").alias("n"), (F.max("pos") - F.min("pos")).alias("span"))
    return per_path.groupBy(node).agg(F.sum("n").alias("occurrences"), F.count("*").alias("carriers"), F.max("n").alias("most"), F.max("span").alias("span"))


def dispersed(spectrum: DataFrame, occurrences: int = 64, per_path: float = 2.0, span: int = 1000) -> DataFrame:
    """Nodes of a spectrum that glue distant places together: many occurrences, several to a path, far apart."""
    return spectrum.where((F.col("occurrences") >= occurrences) & (F.col("most") >= 2) & (F.col("occurrences") / F.col("carriers") >= per_path) & (F.col("span") >= span))


def masked_nodes(walk: DataFrame, fraction: float = 0.0, most: int | None = None, node: str = "kmer") -> DataFrame:
    """The ``fraction`` of nodes with most occurrences (ties to the lesser) and those with more than ``most``."""
    counts = walk.groupBy(node).agg(F.count("*").alias("n"))
    top = int(counts.count() * fraction)
    out = counts.orderBy(F.desc("n"), node).limit(top).select(node)
    return out if most is None else out.unionByName(counts.where(F.col("n") > most).select(node)).distinct()


def supported_occurrences(walk: DataFrame, n: int, node: str = "kmer") -> DataFrame:
    """path_id and step of the occurrences that lie in a run of ``n`` steps, with its distances, which occurs more than once in either reading."""
    from loomspan.operators import seeds

    runs = seeds.ordered_seeds(walk, n)
    shared = runs.withColumn("_r", F.least("ahead", "back")).withColumn("_n", F.count("*").over(Window.partitionBy("_r"))).where("_n > 1")
    return shared.select("path_id", F.explode(F.sequence(F.col("step"), F.col("step") + n - 1)).alias("step")).distinct()


def private_occurrences(walk: DataFrame, frequent: DataFrame, supported: DataFrame, node: str = "kmer") -> DataFrame:
    """path_id and step of the occurrences of frequent nodes that nothing around them supports: they become nodes of their own."""
    return walk.join(frequent.select(node), node, "left_semi").join(supported, ["path_id", "step"], "left_anti").select("path_id", "step")


def smoothable_blocks(segments: DataFrame, steps: DataFrame, most_weight: int, most_jump: int) -> DataFrame:
    """seg_id, block: neighbouring segments (in order) with about ``most_weight`` bases of path through them each.

    A block ends where its weight is full, by the running total of the weights, or where no path goes from a segment to the next one or over it.
    """
    weight = node_coverage(segments, steps).select("seg_id", "len", (F.col("len") * F.col("visits")).alias("w"))
    laid = ordered(weight, "seg_id", total="w", running="before")
    spans = gaps(segments, steps).where(F.col("jump") <= most_jump).select("a", "b")
    order = laid.select(F.col("seg_id").alias("_s"), F.col("ord").alias("_o"))
    x, y = order.select(F.col("_s").alias("a"), F.col("_o").alias("_oa")), order.select(F.col("_s").alias("b"), F.col("_o").alias("_ob"))
    ends = spans.join(x, "a").join(y, "b").select(F.explode(F.array(F.struct((F.least("_oa", "_ob") + 1).alias("at"), F.lit(1).alias("d")), F.struct((F.greatest("_oa", "_ob") + 1).alias("at"), F.lit(-1).alias("d")))).alias("e")).groupBy(F.col("e.at").alias("ord")).agg(F.sum("e.d").alias("d"))
    opened = laid.join(ends, "ord", "left").fillna(0, ["d"])
    crossed = ordered(opened, "ord", index="_rank", total="d", running="_open")
    cut_here = ((F.col("_open") + F.col("d")) <= 0) | (F.floor(F.col("before") / most_weight) != F.floor((F.col("before") - F.col("w")) / most_weight))
    marked = ordered(crossed.withColumn("_cut", cut_here.cast("int")), "ord", index="_rank2", total="_cut", running="_blocks")
    return marked.select("seg_id", (F.col("_blocks") + F.col("_cut")).alias("block"))


def linear_chains(links: DataFrame, segments: DataFrame) -> DataFrame:
    """seg_id and chain, for unitigs: segments joined where a node's only way out is another's only way in (forward to forward)."""
    plain = links.where("from_orient = '+' and to_orient = '+' and from_id <> to_id").select("from_id", "to_id").distinct()
    touched = links.select(F.explode(F.array(F.struct(F.col("from_id").alias("s"), F.when(F.col("from_orient") == "+", "out").otherwise("in").alias("side")), F.struct(F.col("to_id").alias("s"), F.when(F.col("to_orient") == "+", "in").otherwise("out").alias("side")))).alias("e")).groupBy("e.s", "e.side").agg(F.count("*").alias("n"))
    outs, ins = (touched.where(f"side = '{k}' and n = 1").select(F.col("s").alias(f"_{k}")) for k in ("out", "in"))
    only = plain.join(outs, F.col("from_id") == F.col("_out")).join(ins, F.col("to_id") == F.col("_in")).select("from_id", F.lit("+").alias("from_orient"), "to_id", F.lit("+").alias("to_orient"))
    return components(segments, only).withColumnRenamed("comp", "chain")


def simple_bubbles(links: DataFrame) -> DataFrame:
    """Sites where a source reaches a sink through two or more single segments, or through one and directly: source, sink, branches, direct."""
    a = links.select(label("from_id", "from_orient").alias("source"), label("to_id", "to_orient").alias("mid"))
    b = links.select(label("from_id", "from_orient").alias("mid"), label("to_id", "to_orient").alias("sink"))
    through = a.join(b, "mid").where("source <> sink and source <> mid and mid <> sink").groupBy("source", "sink").agg(F.count_distinct("mid").alias("branches"))
    direct = a.select("source", F.col("mid").alias("sink")).distinct().withColumn("direct", F.lit(1))
    joined = through.join(direct, ["source", "sink"], "left").select("source", "sink", "branches", F.coalesce("direct", F.lit(0)).alias("direct"))
    return joined.where("branches + direct >= 2")


def metrics(segments: DataFrame, links: DataFrame, steps: DataFrame, high_fraction: float = 0.5, sparse_fraction: float = 0.1, least_gap: int = 1000) -> DataFrame:
    """The report's figures, one row for each: metric and value."""
    coverage = cut(node_coverage(segments, steps))
    found = cut(gaps(segments, steps))
    n_paths = steps.select("path_id").distinct().count()
    high = max(2, -(-int(n_paths * high_fraction * 1000) // 1000))
    frac = F.col("paths") / max(1, n_paths)
    on_nodes = coverage.agg(
        F.count("*").alias("segments"), F.sum("len").alias("total_segment_bp"), F.sum("visits").alias("node_path_step_visits"), F.avg("visits").alias("node_coverage_mean"),
        (F.sum(F.col("visits") * F.col("len")) / F.sum("len")).alias("node_coverage_bp_weighted_mean"),
        *(nearest_rank("visits", q).alias(f"node_coverage_{n}") for n, q in (("p10", 0.1), ("median", 0.5), ("p90", 0.9))),
        F.sum((F.col("visits") == 1).cast("int")).alias("singleton_nodes"), F.sum(F.when(F.col("visits") == 1, F.col("len")).otherwise(0)).alias("singleton_bp"),
        F.sum((F.col("visits") >= high).cast("int")).alias("high_coverage_nodes"), F.sum(F.when(F.col("visits") >= high, F.col("len")).otherwise(0)).alias("high_coverage_bp"),
        (F.sum(F.col("len") * F.col("paths")) / (F.sum("len") * n_paths)).alias("segment_occupancy_bp_fraction"),
        (F.sum("len") * n_paths - F.sum(F.col("len") * F.col("paths"))).alias("segment_white_space_bp_total"),
        F.sum(F.when(frac <= sparse_fraction, F.col("len")).otherwise(0)).alias("sparse_coverage_segment_bp"),
        F.min("visits").alias("path_depth_min"), nearest_rank("visits", 0.95).alias("path_depth_p95"), F.max("visits").alias("path_depth_max"),
        F.sum((F.col("visits") > n_paths).cast("int")).alias("reused_nodes"),
    )
    on_gaps = found.agg(
        *(nearest_rank("jump", q).alias(f"path_jump_{n}") for n, q in (("p95", 0.95), ("p99", 0.99))), F.max("jump").alias("path_jump_max"),
        *(nearest_rank("gap_bp", q).alias(f"path_white_space_bp_{n}") for n, q in (("p95", 0.95), ("p99", 0.99))), F.max("gap_bp").alias("path_white_space_bp_max"),
        F.sum("gap_bp").alias("path_white_space_bp_total"), F.avg("gap_bp").alias("path_white_space_bp_mean"),
        F.sum((F.col("gap_bp") > 0).cast("int")).alias("path_white_space_bridges"), F.sum((F.col("gap_bp") >= least_gap).cast("int")).alias("path_white_space_bridges_ge_threshold"),
    )
    copies = segments.groupBy("seq").agg(F.count("*").alias("n")).agg(
        F.coalesce(F.sum((F.col("n") > 1).cast("int")), F.lit(0)).alias("duplicate_sequence_groups"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicate_sequence_nodes"), F.max("n").alias("max_duplicate_count"))
    loops = links.agg(F.count("*").alias("links"), F.sum((F.col("from_id") == F.col("to_id")).cast("int")).alias("direct_self_loop_edges"), F.count_distinct(F.when(F.col("from_id") == F.col("to_id"), F.col("from_id"))).alias("direct_self_loop_nodes"))
    pairs = neighbours(steps).agg(F.sum((F.col("a") == F.col("b")).cast("int")).alias("adjacent_same_node_path_steps"), F.sum(((F.col("a") == F.col("b")) & (F.col("a_orient") == F.col("b_orient"))).cast("int")).alias("adjacent_same_step_path_steps"))
    walks = steps.agg(F.count("*").alias("path_steps"), F.count_distinct("path_id").alias("paths"))
    sizes = components(segments, links).groupBy("comp").agg(F.count("*").alias("n")).agg(F.count("*").alias("components"), F.max("n").alias("largest_component_nodes"))
    ends = tips(segments, links, steps).agg(F.count("*").alias("tips"), F.coalesce(F.sum(F.col("internal").cast("int")), F.lit(0)).alias("internal_tips"))
    runs = repeat_runs(steps).agg(F.count("*").alias("self_loop_repeat_runs"), F.coalesce(F.max("run"), F.lit(0)).alias("self_loop_max_repeat_run_len"))
    out = None
    for one in (on_nodes, on_gaps, copies, loops, pairs, walks, sizes, ends, runs):
        long = one.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, one.columns)), F.array(*(F.col(c).cast("double") for c in one.columns)))).alias("metric", "value"))
        out = long if out is None else out.unionByName(long)
    return out


def depth_runs(segments: DataFrame, steps: DataFrame, part: float = 0.8, of_paths: float = 0.5) -> DataFrame:
    """Runs of neighbouring segments whose depth reaches ``part`` of the largest, that share of the paths' number, and 2."""
    coverage = node_coverage(segments, steps)
    placed = cut(ordered(coverage, "seg_id"))
    n_paths = steps.select("path_id").distinct().count()
    deepest = placed.agg(F.max("visits")).first()[0] or 0
    least = max(-(-deepest * int(part * 100) // 100), int(n_paths * of_paths), 2)
    return _islands(placed.where(F.col("visits") >= least)).agg(F.min("ord").alias("start_order"), F.max("ord").alias("end_order"), F.count("*").alias("nodes"), F.min("visits").alias("min_depth"), F.max("visits").alias("max_depth"), F.sum("visits").alias("sum_depth")).drop("_island")


def sparse_runs(segments: DataFrame, steps: DataFrame, most_fraction: float) -> DataFrame:
    """Runs of neighbouring segments that at most a fraction of the paths visit."""
    placed = cut(ordered(node_coverage(segments, steps), "seg_id"))
    n_paths = steps.select("path_id").distinct().count()
    few = placed.where(F.col("paths") / max(1, n_paths) <= most_fraction)
    return _islands(few).agg(F.min("ord").alias("start_order"), F.max("ord").alias("end_order"), F.count("*").alias("nodes"), F.sum("len").alias("bp"), F.sum(F.col("len") * (n_paths - F.col("paths"))).alias("missing_path_bp")).drop("_island")


def _islands(df: DataFrame):
    """Groups of consecutive ``ord``: a row's order less its rank among those kept is constant in a run."""
    ranked = ordered(df, "ord", index="_rank")
    return ranked.withColumn("_island", F.col("ord") - F.col("_rank")).groupBy("_island")
