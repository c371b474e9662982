"""Writers of the line formats: each gives the lines as a DataFrame, or writes them as text."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions.sequences import wrapped
from loomspan.operators import cigar


def bed_lines(rows: DataFrame) -> DataFrame:
    return rows.select(F.concat_ws("\t", "chrom", "start", "end", "name", "score", "strand").alias("value"))


def paf_lines(rows: DataFrame) -> DataFrame:
    """From query, qlen, qs, qe, strand, target, tlen, ts, te and cigar; matches and block length come from the operations."""
    s = cigar.stats(F.col("cigar"))
    block = s["matches"] + s["mismatches"] + s["inserted"] + s["deleted"]
    return rows.select(F.concat_ws("\t", "query", "qlen", "qs", "qe", "strand", "target", "tlen", "ts", "te", s["matches"].cast("string"), block.cast("string"), F.lit("255"), F.concat(F.lit("cg:Z:"), cigar.render(F.col("cigar")))).alias("value"))


def bedpe_lines(rows: DataFrame) -> DataFrame:
    return rows.select(F.concat_ws("\t", "query", "qs", "qe", "target", "ts", "te", "name", F.lit("0"), "strand", F.lit("+")).alias("value"))


def fasta_lines(rows: DataFrame, width: int = 80) -> DataFrame:
    return rows.select(F.concat(F.lit(">"), F.col("name"), F.lit("\n"), wrapped(F.col("seq"), width)).alias("value"))


def gfa_lines(segments: DataFrame, links: DataFrame, steps: DataFrame) -> DataFrame:
    """S, L and P lines of (seg_id, seq), links and (path_id, idx, seg_id, orient), and the header."""
    head = segments.sparkSession.createDataFrame([("H\tVN:Z:1.0",)], "value string")
    s = segments.select(F.concat_ws("\t", F.lit("S"), "seg_id", "seq").alias("value"))
    l = links.select(F.concat_ws("\t", F.lit("L"), "from_id", "from_orient", "to_id", "to_orient", F.lit("0M")).alias("value"))
    walk = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", F.concat(F.col("seg_id").cast("string"), F.col("orient")).alias("s")))), lambda x: x["s"]), ",")
    p = steps.groupBy("path_id").agg(walk.alias("walk")).select(F.concat_ws("\t", F.lit("P"), "path_id", "walk", F.lit("*")).alias("value"))
    return head.unionByName(s).unionByName(l).unionByName(p)


def pack_lines(counts: DataFrame) -> DataFrame:
    return counts.select(F.concat_ws("\t", "node_id", "cnt").alias("value"))


def maf_lines(rows: DataFrame) -> DataFrame:
    """``s`` lines of an alignment's rows: name, start, strand, length and aligned bases."""
    size = F.length(F.replace("aligned", F.lit("-"), F.lit("")))
    return rows.select(F.concat_ws(" ", F.lit("s"), "name", "start", size.cast("string"), "strand", "length", "aligned").alias("value"))


def write(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)


def write_index(found: DataFrame, path: str, buckets: int = 64) -> None:
    """Alignment entries as an index: Parquet files by target, sorted by start within each, so that a region reads few row groups."""
    dealt = found.withColumn("bucket", F.pmod(F.xxhash64("target_id"), F.lit(buckets)).cast("int")).repartition("bucket", F.floor(F.col("ts") / (1 << 24))).sortWithinPartitions("bucket", "target_id", "ts")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_index(spark: SparkSession, *paths: str) -> DataFrame:
    """The entries of one or more indices; ids are those of one dictionary of sequences."""
    return functools.reduce(DataFrame.unionByName, [spark.read.parquet(p).drop("bucket") for p in paths])


def unified(found: DataFrame, names: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Entries with the ids of their own file's sequences (``names``: seq_id, name) turned into those of a common dictionary."""
    ids = names.join(dictionary.select(F.col("seq_id").alias("_to"), "name"), "name").select(F.col("seq_id").alias("_from"), "_to")
    for side in ("query_id", "target_id"):
        found = found.join(ids, F.col(side) == F.col("_from")).withColumn(side, F.col("_to")).drop("_from", "_to")
    return found


def partition_lines(parts: DataFrame, names: DataFrame, single: bool = False) -> DataFrame:
    """part and the BED line of each range of a partition (seq_id, start, stop, part): three columns, or with the partition as a fourth for one file."""
    low, high = F.least("start", "stop").cast("string"), F.greatest("start", "stop").cast("string")
    named = parts.join(names.select("seq_id", "name"), "seq_id")
    return named.select("part", F.concat_ws("\t", "name", low, high, *([F.col("part").cast("string")] if single else [])).alias("value"))


def partition_records(parts: DataFrame, sequences: DataFrame, width: int = 80) -> DataFrame:
    """part and the FASTA record of each range (name, start, end, strand, part): ``name:start-end``, ``/rc`` where it is read backwards."""
    from loomspan.operators import msa

    found = msa.members(parts, sequences)
    head = F.concat(F.format_string(">%s:%d-%d", "name", "start", "end"), F.when(F.col("strand") == "-", "/rc").otherwise(""))
    return found.select("part", F.concat(head, F.lit("\n"), wrapped(F.col("seq"), width)).alias("value"))


def write_partitions(lines: DataFrame, path: str, kind: str, single: bool = False) -> None:
    """Lines of partitions (part, value) as text, a folder for each partition, or in one; only BED can go into one."""
    if kind not in ("bed", "fasta", "gfa", "maf", "vcf"):
        raise ValueError(f"no format {kind}")
    if single and kind != "bed":
        raise ValueError(f"{kind} needs a file for each partition")
    if single:
        lines.select("value").write.mode("overwrite").text(path)
    else:
        lines.repartition("part").write.mode("overwrite").partitionBy("part").text(path)


def typed_pack_lines(counts: DataFrame, kind: dict[str, str]) -> DataFrame:
    """A pack table's lines with a header that names its kind, sorted by node."""
    head = counts.sparkSession.createDataFrame([(f"#{k}\t{v}",) for k, v in sorted(kind.items())] + [("#node\tcount",)], "value string").coalesce(1)
    return head.unionByName(counts.orderBy("node_id").select(F.concat_ws("\t", "node_id", "cnt").alias("value")))


def contribution_lines(visits: DataFrame) -> DataFrame:
    """A line for each visit of a read's walk: read, place, node, start and end."""
    return visits.select(F.concat_ws("\t", "read_id", "idx", "seg_id", "start", "end").alias("value"))


def genotype_lines(ranked: DataFrame, ploidy: int) -> DataFrame:
    """locus_id and the ranked lines of genotypes: locus, rank, candidates with commas between, similarity, qv, with seven decimals at most."""
    from loomspan.functions.sequences import short_number

    names = F.concat_ws(",", *(F.col(f"c{p}").cast("string") for p in range(1, ploidy + 1)))
    return ranked.select("locus_id", "rank", F.concat_ws("\t", F.col("locus_id").cast("string"), F.col("rank").cast("string"), names, short_number(F.col("similarity")), short_number(F.col("qv"))).alias("value"))


def mosaic_lines(mosaics: DataFrame) -> DataFrame:
    """sample_id and, for each stretch of loci in which a mosaic keeps its candidate, a line: sample, first and last locus, candidate."""
    from pyspark.sql import Window

    order = Window.partitionBy("sample_id").orderBy("locus")
    fresh = F.when(F.lag("cand_id").over(order).eqNullSafe(F.col("cand_id")), 0).otherwise(1)
    runs = mosaics.withColumn("_f", fresh).withColumn("_run", F.sum("_f").over(order)).groupBy("sample_id", "_run", "cand_id").agg(F.min("locus").alias("a"), F.max("locus").alias("b"))
    return runs.select("sample_id", F.concat_ws("\t", *(F.col(c).cast("string") for c in ("sample_id", "a", "b", "cand_id"))).alias("value"))


def mosaic_records(mosaics: DataFrame, spelled: DataFrame) -> DataFrame:
    """sample_id and the FASTA record of a mosaic: the bases of its candidates (cand_id, seq), locus after locus."""
    both = mosaics.join(spelled, "cand_id").groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("locus", "seq"))).alias("p"))
    seq = F.array_join(F.transform("p", lambda x: x["seq"]), "")
    return both.select("sample_id", F.concat(F.lit(">"), F.col("sample_id").cast("string"), F.lit("\n"), wrapped(seq)).alias("value"))


def ordination_lines(coordinates: DataFrame) -> DataFrame:
    """region, group, axis and value, with seven decimals."""
    return coordinates.select(F.concat_ws("\t", F.col("region_id").cast("string"), "grp", F.col("pc").cast("string"), F.format_string("%.7f", "value")).alias("value"))


def report_lines(metrics: DataFrame, markdown: bool = False) -> DataFrame:
    """Figures (metric, value) as a table in TSV or Markdown, by name."""
    from loomspan.functions.sequences import short_number

    shown = short_number(F.col("value"))
    rows = metrics.orderBy("metric").select(F.concat(F.lit("| "), "metric", F.lit(" | "), shown, F.lit(" |")).alias("value") if markdown else F.concat_ws("\t", "metric", shown).alias("value"))
    head = ["| metric | value |", "|---|---|"] if markdown else ["metric\tvalue"]
    return metrics.sparkSession.createDataFrame([(h,) for h in head], "value string").coalesce(1).unionByName(rows)


def w_lines(walks: DataFrame) -> DataFrame:
    """W lines from sample, hap, contig, start, end and walk, an array of (name, orient)."""
    text = F.array_join(F.transform("walk", lambda s: F.concat(F.when(s["orient"] == "-", "<").otherwise(">"), s["name"])), "")
    return walks.select(F.concat_ws("\t", F.lit("W"), "sample", F.col("hap").cast("string"), "contig", F.col("start").cast("string"), F.col("end").cast("string"), text).alias("value"))


def write_manifest(spark: SparkSession, path: str, values: dict) -> None:
    """A manifest: one line of JSON, keys in order."""
    import json

    spark.createDataFrame([(json.dumps(values, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_projection(counts: DataFrame, path: str, values: dict) -> None:
    """A projection bundle: counts as Parquet and a manifest."""
    counts.write.mode("overwrite").parquet(f"{path}/counts")
    write_manifest(counts.sparkSession, f"{path}/manifest", values | {"kind": "projection"})
