"""Lacing: path fragments of windows joined to paths, and variant files of windows to one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions.sequences import contig_order, region
from loomspan.operators import graph, intervals


def lace(fragments: DataFrame, key: str = "key", start: str = "start", stop: str = "stop") -> DataFrame:
    """The pieces of each laced path in order: key, idx, kind (range or gap), start, stop.

    Contained fragments go; of overlapping ones the later is trimmed; gaps between neighbours become pieces.
    """
    kept = intervals.contained_dropped(fragments.select(key, start, stop).where(F.col(start) < F.col(stop)), [key], start, stop)
    order = Window.partitionBy(key).orderBy(start)
    before = F.lag(stop).over(order)
    cut_ = kept.withColumn("_before", before).withColumn("_from", F.greatest(F.col(start), F.coalesce("_before", F.col(start))))
    gap = F.when(F.col("_before") < F.col(start), F.struct(F.lit("gap").alias("kind"), F.col("_before").alias(start), F.col(start).alias(stop)))
    piece = F.struct(F.lit("range").alias("kind"), F.col("_from").alias(start), F.col(stop).alias(stop))
    each = cut_.select(key, F.explode(F.filter(F.array(gap, piece), lambda x: x.isNotNull())).alias("p")).select(key, "p.kind", f"p.{start}", f"p.{stop}")
    return each.withColumn("idx", F.row_number().over(Window.partitionBy(key).orderBy(start)) - 1).select(key, "idx", "kind", start, stop)


def unused_segments(segments: DataFrame, steps: DataFrame) -> DataFrame:
    return segments.join(steps.select("seg_id").distinct(), "seg_id", "left_anti")


def gap_sequences(pieces: DataFrame, sequences: DataFrame | None, key: str = "key") -> DataFrame:
    """Gap pieces with the bases to fill them: those of the sequence, or as many N."""
    gaps = pieces.where("kind = 'gap'")
    n = F.expr("repeat('N', cast(stop - start as int))")
    if sequences is None:
        return gaps.withColumn("seq", n)
    joined = gaps.join(sequences.select(F.col(key).alias("_k"), F.col("seq").alias("_seq")), F.col(key) == F.col("_k"), "left")
    return joined.withColumn("seq", F.coalesce(F.when(F.length("_seq") >= F.col("stop"), F.substr("_seq", F.col("start") + 1, F.col("stop") - F.col("start"))), n)).drop("_k", "_seq")


def lace_vcf(calls: DataFrame) -> DataFrame:
    """One row for each variant of all windows: chrom, pos, ref, alt and genotypes of all samples in order of name.

    ``calls``: window chrom (``name:start-end``), pos, ref, alt, sample, gt.  Positions move by the window's start;
    a sample that a window doesn't have is ``./.``; a variant of several windows stands once, its least genotype string winning.
    """
    pattern = r"^(.*):([0-9]+)-([0-9]+)$"
    inside = F.col("chrom").rlike(pattern)
    moved = calls.select(
        F.when(inside, F.regexp_extract("chrom", pattern, 1)).otherwise(F.col("chrom")).alias("chrom"),
        (F.col("pos") + F.when(inside, F.regexp_extract("chrom", pattern, 2).try_cast("long")).otherwise(0)).alias("pos"), "ref", "alt", "sample", "gt",
    ).groupBy("chrom", "pos", "ref", "alt", "sample").agg(F.min("gt").alias("gt"))
    # The samples are the columns of the output's header line, so their names fit the driver.
    names = sorted(r["sample"] for r in moved.select("sample").distinct().collect())
    by_sample = moved.groupBy("chrom", "pos", "ref", "alt").agg(F.map_from_entries(F.collect_list(F.struct("sample", "gt"))).alias("m"))
    held = F.transform(F.lit(names) if names else F.array().cast("array<string>"), lambda n: F.coalesce(F.try_element_at("m", n), F.lit("./.")))
    return by_sample.select("chrom", "pos", "ref", "alt", F.array_join(held, "\t").alias("genotypes"))


def lace_graphs(segments: DataFrame, steps: DataFrame, sequences: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Subgraphs whose paths are named ``name:start-end`` as one graph with a path for each name: segments, links, steps.

    Contained paths go; where two overlap, the later one loses its first bases, and the segment that the cut falls into is split
    for it (``segment~bases``); gaps between paths become segments of the sequence's bases (``sequences``: key, seq) or of N.
    Segments that no path has any more are left out.  Names of segments are strings.
    """
    named = steps.select("path_id").distinct().withColumn("r", region(F.col("path_id").cast("string")))
    known = named.select("path_id", F.coalesce("r", F.raise_error(F.concat(F.lit("no range in the path's name: "), F.col("path_id").cast("string"))).cast("struct<name:string,start:int,end:int>")).alias("r"))
    spans = known.select("path_id", F.col("r.name").alias("key"), F.col("r.start").alias("start"), F.col("r.end").alias("stop"))
    # One path for each range, then those that no other contains, each with where the one before ends.
    one = spans.groupBy("key", "start", "stop").agg(F.min("path_id").alias("path_id"))
    kept = intervals.contained_dropped(one, ["key"], "start", "stop")
    before = F.lag("stop").over(Window.partitionBy("key").orderBy("start"))
    trims = kept.withColumn("_before", before).withColumn("trim", F.greatest(F.lit(0), F.coalesce("_before", F.col("start")) - F.col("start")))
    placed = graph.path_positions(segments, steps).join(trims.select("path_id", "key", F.col("start").alias("at"), "trim"), "path_id").where(F.col("end") > F.col("trim"))
    lost = F.greatest(F.lit(0), F.col("trim") - F.col("start"))
    cut_ = placed.join(segments.select(F.col("seg_id").alias("_s"), "seq"), F.col("seg_id") == F.col("_s")).withColumn("lost", lost)
    size = F.length("seq") - F.col("lost")
    # Read along the path, a split segment loses its first bases: its last ones if it is read backwards.
    left = F.when(F.col("orient") == "-", F.substr("seq", F.lit(1), size)).otherwise(F.substr("seq", F.col("lost") + 1, size))
    name = F.concat(F.col("seg_id").cast("string"), F.when(F.col("lost") > 0, F.concat(F.lit("~"), F.when(F.col("orient") == "-", "-").otherwise(""), F.col("lost").cast("string"))).otherwise(""))
    own = cut_.select("key", (F.col("at") + F.col("start") + F.col("lost")).cast("long").alias("at"), name.alias("seg_id"), "orient", left.alias("seq"))
    pieces = lace(one.select("key", "start", "stop"))
    gaps = gap_sequences(pieces, sequences).select("key", F.col("start").cast("long").alias("at"), F.format_string("gap:%s:%d-%d", "key", "start", "stop").alias("seg_id"), F.lit("+").alias("orient"), "seq")
    every = own.unionByName(gaps)
    walked = every.select(F.col("key").alias("path_id"), (F.row_number().over(Window.partitionBy("key").orderBy("at")) - 1).alias("idx"), "seg_id", "orient")
    whole = every.groupBy("seg_id").agg(F.first("seq").alias("seq")).select("seg_id", F.length("seq").alias("len"), "seq")
    links = graph.neighbours(walked).select(F.col("a").alias("from_id"), F.col("a_orient").alias("from_orient"), F.col("b").alias("to_id"), F.col("b_orient").alias("to_orient")).distinct()
    return whole, links, walked


def lace_vcf_records(calls: DataFrame) -> tuple[list[str], DataFrame]:
    """The samples in order, and for each variant of all windows chrom, pos, ref, alt, format and the samples' values.

    ``calls``: window chrom (``name:start-end``), pos, ref, alt, sample, format, call.  A variant's format has the keys of all its
    windows, GT first, then by name; a key that a sample lacks is ``./.`` for GT, otherwise ``.``.  Rows come by contig (1 to 22,
    X, Y, M, then names) and position.
    """
    inside = region(F.col("chrom"))
    one = F.map_from_arrays(F.split("format", ":"), F.slice(F.concat(F.split("call", ":"), F.transform(F.split("format", ":"), lambda k: F.when(k == "GT", "./.").otherwise("."))), F.lit(1), F.size(F.split("format", ":"))))
    moved = calls.select(F.coalesce(inside["name"], F.col("chrom")).alias("chrom"), (F.col("pos") + F.coalesce(inside["start"], F.lit(0))).alias("pos"), "ref", "alt", "sample", "format", "call", one.alias("m"))
    keys = moved.groupBy("chrom", "pos", "ref", "alt").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.split("format", ":"))))).alias("k"))
    formats = keys.withColumn("k", F.concat(F.filter("k", lambda x: x == "GT"), F.filter("k", lambda x: x != "GT")))
    best = moved.groupBy("chrom", "pos", "ref", "alt", "sample").agg(F.min_by("m", F.struct("call", "format")).alias("m"))
    # The samples are the columns of the header line, so their names fit the driver.
    names = sorted(r["sample"] for r in moved.select("sample").distinct().collect())
    by_sample = best.groupBy("chrom", "pos", "ref", "alt").agg(F.map_from_entries(F.collect_list(F.struct("sample", "m"))).alias("s")).join(formats, ["chrom", "pos", "ref", "alt"])

    def value(m, k):
        return F.coalesce(F.try_element_at(m, k), F.when(k == "GT", "./.").otherwise("."))

    texts = F.transform(F.lit(names) if names else F.array().cast("array<string>"), lambda n: F.array_join(F.transform("k", lambda k: value(F.try_element_at(F.col("s"), n), k)), ":"))
    rows = by_sample.select("chrom", "pos", "ref", "alt", F.array_join("k", ":").alias("format"), F.array_join(texts, "\t").alias("genotypes"))
    rank, name = contig_order(F.col("chrom"))
    return names, rows.orderBy(rank, name, "pos", "ref", "alt")


def vcf_lines(names: list[str], rows: DataFrame) -> DataFrame:
    """The lines of a VCF file: version, contigs with their last position, columns, records."""
    spark = rows.sparkSession
    rank, name = contig_order(F.col("chrom"))
    contigs = rows.groupBy("chrom").agg(F.max("pos").alias("n")).orderBy(rank, name).collect()  # a line of the header for each contig
    head = ["##fileformat=VCFv4.2", *(f"##contig=<ID={r['chrom']},length={r['n']}>" for r in contigs), "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *names])]
    records = rows.select(F.concat_ws("\t", "chrom", F.col("pos").cast("string"), F.lit("."), "ref", "alt", F.lit("."), F.lit("."), F.lit("."), "format", "genotypes").alias("value"))
    return spark.createDataFrame([(h,) for h in head], "value string").coalesce(1).unionByName(records)
