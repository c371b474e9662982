"""Ranges lifted through alignments: entries, query, approximate query and transitive closure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.functions.sequences import subset_keys
from loomspan.operators import cigar, intervals, lifting
from loomspan.session import cut, dropped, lookup


def once(value: Column) -> Column:
    """``value``, evaluated a single time for each row: the optimizer copies nothing past a generator."""
    return F.explode(F.array(value))


def entries(aln: DataFrame, bidirectional: bool = True) -> DataFrame:
    """Alignments as they are looked up by target: each forward, and with its sides swapped unless it aligns a sequence to itself."""
    names = ["aln_id", "query_id", "qs", "qe", "target_id", "ts", "te", "strand", "cigar"]
    forward = aln.select(*names, F.lit(False).alias("reversed"))
    if not bidirectional:
        return forward
    swapped = aln.where("query_id <> target_id").select(
        "aln_id", F.col("target_id").alias("query_id"), F.col("ts").alias("qs"), F.col("te").alias("qe"),
        F.col("query_id").alias("target_id"), F.col("qs").alias("ts"), F.col("qe").alias("te"), "strand",
        cigar.invert(F.col("cigar"), F.col("strand")).alias("cigar"), F.lit(True).alias("reversed"),
    )
    return forward.unionByName(swapped)


def query(regions: DataFrame, found: DataFrame, min_identity: float | None = None, min_length: int = 0, with_self: bool = True, keep: tuple[str, ...] = ("region_id",), with_cigar: bool = False, with_stats: bool = False, width: int = intervals.BIN) -> DataFrame:
    """Hits of ``regions`` (keep, seq_id, r_start, r_end): the keep columns, query_id, q_first, q_last, target_id, t_first, t_last.

    q_first > q_last says that the hit runs backwards.  Each region itself is a hit too.  ``with_stats`` adds the bases and gaps of
    the clipped CIGARs (``lifting.STATS``), ``with_cigar`` these themselves.
    """
    r = regions.select(*keep, F.col("seq_id").alias("_seq"), "r_start", "r_end")
    if with_cigar:
        out = _with_cigars(r, found, min_identity, keep, width)
    else:
        stats = with_stats or min_identity is not None
        names = ["query_id", "q_first", "q_last", "target_id", "t_first", "t_last", *(lifting.STATS if stats else ())]
        kinds = {c: found.schema[c].dataType.simpleString() for c in ("query_id", "target_id")}
        out = lifting.lifted(r, found, cigar.render(F.col("cigar")), lifting.rows(keep, names, min_length, min_identity), [(c, kinds.get(c, "int")) for c in names], keep, stats=stats)
        if stats and not with_stats:
            out = out.drop(*lifting.STATS)
    if with_self:
        more = []
        if with_stats:
            more = [F.when(F.lit(c == "matches"), F.col("r_end") - F.col("r_start")).otherwise(0).cast("int").alias(c) for c in lifting.STATS]
        if with_cigar:
            more = [F.array(F.struct((F.col("r_end") - F.col("r_start")).cast("int").alias("len"), F.lit("=").alias("op"))).cast(cigar.TYPE).alias("cigar")]
        own = r.select(*keep, F.col("_seq").alias("query_id"), F.col("r_start").alias("q_first"), F.col("r_end").alias("q_last"), F.col("_seq").alias("target_id"), F.col("r_start").alias("t_first"), F.col("r_end").alias("t_last"), *more)
        out = own.unionByName(out)
    return out.where(F.abs(F.col("q_last") - F.col("q_first")) >= min_length) if min_length else out


def _with_cigars(r: DataFrame, found: DataFrame, min_identity: float | None, keep: tuple[str, ...], width: int) -> DataFrame:
    joined = intervals.overlap_join(found, r, [("target_id", "_seq")], ("ts", "te"), ("r_start", "r_end"), width=width)
    hit = cigar.project(F.col("cigar"), *(F.col(c) for c in ("ts", "te", "qs", "qe", "strand", "r_start", "r_end")))
    hits = joined.withColumn("hit", once(hit)).where(F.col("hit").isNotNull()).withColumn("clip", once(cigar.clipped(F.col("cigar"), F.col("hit")))).drop("cigar").withColumnRenamed("clip", "cigar")
    if min_identity is not None:
        hits = hits.where(cigar.gap_compressed_identity(F.col("cigar")) >= min_identity)
    return hits.select(*keep, "query_id", "hit.q_first", "hit.q_last", "target_id", "hit.t_first", "hit.t_last", "cigar")


def bed(hits: DataFrame, seqs: DataFrame, name: Column | None = None) -> DataFrame:
    """BED rows: chrom, start, end, name, score, strand."""
    return hits.join(lookup(seqs.select(F.col("seq_id").alias("_id"), F.col("name").alias("_name"))), F.col("query_id") == F.col("_id")).select(
        F.col("_name").alias("chrom"), F.least("q_first", "q_last").alias("start"), F.greatest("q_first", "q_last").alias("end"),
        (name if name is not None else F.lit(".")).cast("string").alias("name"), F.lit(".").alias("score"), strand_of(F.col("q_first"), F.col("q_last")).alias("strand"),
    )


def strand_of(first: Column, last: Column) -> Column:
    return F.when(first <= last, "+").otherwise("-")


def forward(hits: DataFrame) -> DataFrame:
    """Hits with q_start < q_end and a strand."""
    return hits.withColumns({"q_start": F.least("q_first", "q_last"), "q_end": F.greatest("q_first", "q_last"), "strand": strand_of(F.col("q_first"), F.col("q_last"))})


def merged(hits: DataFrame, distance: int, keep: tuple[str, ...] = ("region_id",), by_strand: bool = False) -> DataFrame:
    """Hits on one query sequence joined within ``distance``; orientation is lost unless ``by_strand``."""
    keys = [*keep, "query_id", *(["strand"] if by_strand else [])]
    return intervals.merge(forward(hits).select(*keys, "q_start", "q_end"), keys, "q_start", "q_end", distance)


def query_merged(regions: DataFrame, found: DataFrame, distance: int, by_strand: bool = False) -> DataFrame:
    """``merged`` hits of ``query``.  Where each region stands once, its hits are joined where they are found, so they aren't shuffled."""
    if distance < 0 or not regions.groupBy("region_id").agg(F.count("*").alias("n")).where("n > 1 or region_id is null").isEmpty():
        return merged(query(regions, found), distance, by_strand=by_strand)
    keep = ("region_id",)
    r = regions.select(*keep, F.col("seq_id").alias("_seq"), "r_start", "r_end")
    more = [("query_id", found.schema["query_id"].dataType.simpleString()), *([("strand", "string")] if by_strand else []), ("q_start", "int"), ("q_end", "int"), ("n_merged", "long")]
    return lifting.lifted(r, found, cigar.render(F.col("cigar")), lifting.runs(keep, distance, by_strand), more, keep)


def approximate(regions: DataFrame, found: DataFrame, keep: tuple[str, ...] = ("region_id",)) -> DataFrame:
    """Hits by interpolation in the first and last overlapped segment of each alignment's tracepoints, without touching bases.

    ``found`` has ``trace``, an array of (dt, dq) steps along target and query.  Rounds half up.
    """
    r = regions.select(*keep, F.col("seq_id").alias("_seq"), "r_start", "r_end")
    names = ["query_id", "q_first", "q_last", "target_id", "t_first", "t_last"]
    kinds = {c: found.schema[c].dataType.simpleString() for c in ("query_id", "target_id")}
    return lifting.lifted(r, found, lifting.rendered_trace(F.col("trace")), lifting.rows(keep, names), [(c, kinds.get(c, "int")) for c in names], keep, approximate=True)


def tracepoints(ops: Column, spacing: int) -> Column:
    """(dt, dq) steps from a CIGAR, cut where the target offset passes a multiple of ``spacing`` at an operation's end."""
    start = F.struct(F.lit(0).alias("t"), F.lit(0).alias("q"), F.array().cast("array<struct<dt:int,dq:int>>").alias("steps"))
    def add(a: Column, o: Column) -> Column:
        t, q = a["t"] + cigar.target_delta(o), a["q"] + cigar.query_delta(o)
        full = t >= spacing
        grown = F.concat(a["steps"], F.array(F.struct(t.cast("int").alias("dt"), q.cast("int").alias("dq"))))
        return F.struct(F.when(full, 0).otherwise(t).cast("int").alias("t"), F.when(full, 0).otherwise(q).cast("int").alias("q"), F.when(full, grown).otherwise(a["steps"]).alias("steps"))
    def end(a: Column) -> Column:
        return F.when((a["t"] > 0) | (a["q"] > 0), F.concat(a["steps"], F.array(F.struct(a["t"].alias("dt"), a["q"].alias("dq"))))).otherwise(a["steps"])
    return F.aggregate(ops, start, add, end)


def transitive(regions: DataFrame, found: DataFrame, max_depth: int = 2, min_output: int = 0, min_follow: int = 0, apart: int = 0, subset: DataFrame | None = None, mask: DataFrame | None = None) -> DataFrame:
    """Hits of hits, level by level, to ``max_depth`` (0: until nothing new): region_id, depth and the columns of ``query``.

    After each level, the query ranges on other sequences than their target's, merged, less what the
    region has visited, are the next level's ranges.  Every level is written, so plans stay small.

    Pieces shorter than ``min_follow`` count as visited but aren't followed; ranges nearer than ``apart`` to what the region
    visited before the level are left alone (all ranges of a level are judged together, so their order doesn't matter).  ``subset``
    (seq_id) names the sequences that hits may be on, besides their target, which prunes what is followed too.  ``mask``
    (seq_id, r_start, r_end) counts as visited from the start, in every region.
    """
    seeds = regions.select("region_id", "seq_id", "r_start", "r_end")
    keys = ["region_id", "seq_id"]
    seen = intervals.merge(seeds, keys, "r_start", "r_end").select(*keys, "r_start", "r_end")
    found = cut(found)
    frontier, levels, depth = seeds, [], 0
    while True:
        level = query(frontier, found, with_self=depth == 0)
        if subset is not None:
            level = with_subset(level, None, subset)
        hits = cut(level.withColumn("depth", F.lit(depth)))
        levels.append(hits)
        depth += 1
        if max_depth and depth >= max_depth:
            break
        new = forward(hits).where("query_id <> target_id").select("region_id", F.col("query_id").alias("seq_id"), F.col("q_start").alias("r_start"), F.col("q_end").alias("r_end"))
        if apart:
            around = seen.select(F.col("region_id").alias("_region"), F.col("seq_id").alias("_seq"), (F.col("r_start") - apart).alias("_from"), (F.col("r_end") + apart).alias("_to"))
            near = intervals.overlap_join(new, around, [("region_id", "_region"), ("seq_id", "_seq")], ("r_start", "r_end"), ("_from", "_to"), "left_semi")
            over = seen.select(F.col("region_id").alias("_region"), F.col("seq_id").alias("_seq"), F.col("r_start").alias("_from"), F.col("r_end").alias("_to"))
            touching = intervals.overlap_join(near, over, [("region_id", "_region"), ("seq_id", "_seq")], ("r_start", "r_end"), ("_from", "_to"), "left_anti")
            new = new.join(touching.distinct(), ["region_id", "seq_id", "r_start", "r_end"], "left_anti")
        known = seen
        if mask is not None:
            known = seen.unionByName(new.select(*keys).distinct().join(mask, "seq_id").select(*keys, "r_start", "r_end"))
        fresh = cut(intervals.subtract(new, known, keys, "r_start", "r_end"))
        last = (frontier, seen)
        if not max_depth or depth + 1 < max_depth:  # what has been seen matters to a further level only
            seen = cut(intervals.merge(known.select(*keys, "r_start", "r_end").unionByName(fresh), keys, "r_start", "r_end").select(*keys, "r_start", "r_end"))
        followed = fresh.where(F.col("r_end") - F.col("r_start") >= min_follow) if min_follow else fresh
        if last[0] is not seeds:
            dropped(last[0])
        if last[1] is not seen:
            dropped(last[1])
        frontier = followed
        frontier.cut_to = fresh.cut_to
        if frontier.isEmpty():
            break
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out.where(F.abs(F.col("q_last") - F.col("q_first")) >= min_output) if min_output else out


def named_by(seqs: DataFrame, names: DataFrame) -> DataFrame:
    """seq_id of the sequences that a list (name) names: exactly, without coordinates, by sample and haplotype, or by a sample listed without haplotype."""
    asked, listed = subset_keys(F.col("name")), names.select(subset_keys(F.col("name")).alias("k"))
    exact = listed.select(F.explode(F.array("k.name", F.concat(F.lit("n|"), F.substr("k.base", F.lit(3))), "k.base", "k.hap", F.when(F.col("k.hap").isNull(), F.col("k.sample")))).alias("_key")).where("_key is not null").distinct()
    each = seqs.select("seq_id", F.explode(F.array(asked["name"], F.concat(F.lit("n|"), F.substr(asked["base"], F.lit(3))), asked["base"], asked["hap"], asked["sample"])).alias("_key"))
    return each.join(lookup(exact), "_key", "left_semi").select("seq_id").distinct()


def with_subset(hits: DataFrame, seqs: DataFrame | None, keep: DataFrame) -> DataFrame:
    """Hits on the target itself, or on sequences that ``keep`` (seq_id) names."""
    named = hits.join(lookup(keep.select(F.col("seq_id").alias("_keep")).distinct()), F.col("query_id") == F.col("_keep"), "left")
    return named.where(F.col("_keep").isNotNull() | (F.col("query_id") == F.col("target_id"))).drop("_keep")
