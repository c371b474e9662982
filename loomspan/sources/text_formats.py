"""Readers of the line formats: PAF, BED, FASTA, GFA, GAF, pack tables, VCF and name lists, as DataFrames.

All read through ``spark.read.text`` (gzip included), so any store that Spark opens will do.  A malformed line
is an error where the format says so, raised when the rows are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.operators import cigar, msa


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.text(path).where("value <> ''")


def _checked(value: Column, good: Column, message: str) -> Column:
    return F.when(good, value).otherwise(F.raise_error(F.lit(message)).cast("string"))


def read_paf(spark: SparkSession, path: str | list[str], with_cigar: bool = True) -> DataFrame:
    """query, qlen, qs, qe, strand, target, tlen, ts, te, matches, block, mapq and the operations of the ``cg`` tag.

    A line without the tag is an error, as its hits could not be projected; without ``with_cigar`` it has none.
    """
    parts = _lines(spark, path).select(F.split("value", "\t").alias("f"))
    first = _checked(F.get("f", 0), (F.size("f") >= 12) & F.get("f", 4).isin("+", "-"), "a PAF line needs 12 columns and a strand")
    tag = F.substr(F.get(F.filter("f", lambda x: F.startswith(x, F.lit("cg:Z:"))), 0), F.lit(6))
    numbers = {"qlen": 1, "qs": 2, "qe": 3, "tlen": 6, "ts": 7, "te": 8, "matches": 9, "block": 10, "mapq": 11}
    ops = F.coalesce(cigar.parse(tag), F.raise_error(F.lit("a PAF line needs a cg tag of =, X, M, I and D")).cast(cigar.TYPE)) if with_cigar else cigar.parse(tag)
    return parts.select(first.alias("query"), *(F.get("f", i).cast("int").alias(c) for c, i in numbers.items()), F.get("f", 4).alias("strand"), F.get("f", 5).alias("target"), ops.alias("cigar"))


def read_bed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """chrom, start, end and name (column 4, unless empty or ``.``, else ``chrom:start-end``)."""
    f = _lines(spark, path).where("not startswith(value, '#')").select(F.split("value", "\t").alias("f"))
    start, end = F.get("f", 1).cast("int"), F.get("f", 2).cast("int")
    chrom = _checked(F.get("f", 0), (F.size("f") >= 3) & (start < end), "a BED line needs 3 columns and start < end")
    name = F.nullif(F.nullif(F.trim(F.get("f", 3)), F.lit("")), F.lit("."))
    return f.select(chrom.alias("chrom"), start.alias("start"), end.alias("end"), F.coalesce(name, F.format_string("%s:%s-%s", F.get("f", 0), F.get("f", 1), F.get("f", 2))).alias("name"))


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """name (up to white space) and seq: records are split where a line starts with ``>``, so a record is a row and files stay splittable by record."""
    records = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("value")).where(F.trim("value") != "")
    head = F.substring_index("value", "\n", 1)
    return records.select(F.regexp_extract(head, r"^(\S*)", 1).alias("name"), F.regexp_replace(F.substr("value", F.length(head) + 1), r"\s", "").alias("seq"))


def subsequences(ranges: DataFrame, sequences: DataFrame) -> DataFrame:
    """``ranges`` (name, start, end and strand) with the bases of each; a range beyond its sequence is an error."""
    return msa.members(ranges, sequences)


def read_gfa(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """segments (name, seq, len), links and steps (path, idx, name, orient, overlap: bases shared with the step before) of S, L, P and W lines.

    Names of segments and of paths must be distinct, and segments not empty (a length may stand in an ``LN`` tag).
    """
    f = _lines(spark, path).select(F.split("value", "\t").alias("f"))
    tagged = F.substr(F.get(F.filter("f", lambda x: F.startswith(x, F.lit("LN:i:"))), 0), F.lit(6)).cast("int")
    size = F.when(F.get("f", 2) == "*", tagged).otherwise(F.length(F.get("f", 2)))
    whole = F.when(size > 0, size).otherwise(F.raise_error(F.concat(F.lit("an empty segment: "), F.get("f", 1))).cast("int"))
    segments = f.where("f[0] = 'S'").groupBy(F.get("f", 1).alias("name")).agg(F.min(F.get("f", 2)).alias("seq"), F.min(whole).alias("len"), F.count("*").alias("_n"))
    segments = segments.select(_checked(F.col("name"), F.col("_n") == 1, "a segment's name stands twice").alias("name"), "seq", "len")
    links = f.where("f[0] = 'L'").select(F.get("f", 1).alias("from_id"), F.get("f", 2).alias("from_orient"), F.get("f", 3).alias("to_id"), F.get("f", 4).alias("to_orient"), F.get("f", 5).alias("overlap"))
    over = F.transform(F.regexp_extract_all(F.get("f", 3), F.lit("([0-9]+)M"), F.lit(1)), lambda x: x.cast("int"))
    p = f.where("f[0] = 'P'").select(F.get("f", 1).alias("path"), p_walk(F.get("f", 2)).alias("walk"), over.alias("over"))
    w = f.where("f[0] = 'W'").select(F.format_string("%s#%s#%s:%s-%s", *(F.get("f", i) for i in range(1, 6))).alias("path"), w_walk(F.get("f", 6)).alias("walk"), F.array().cast("array<int>").alias("over"))
    walks = p.unionByName(w).groupBy("path").agg(F.first("walk").alias("walk"), F.first("over").alias("over"), F.count("*").alias("_n"))
    one = walks.select(_checked(F.col("path"), F.col("_n") == 1, "a path's name stands twice").alias("path"), F.posexplode("walk").alias("idx", "s"), "over")
    steps = one.select("path", "idx", F.col("s.name").alias("name"), F.col("s.orient").alias("orient"), F.coalesce(F.get("over", F.col("idx") - 1), F.lit(0)).alias("overlap"))
    return segments, links, steps


def p_walk(text: Column) -> Column:
    """``1+,2-`` as (name, orient) structs."""
    return F.transform(F.split(text, ","), lambda x: F.struct(F.substr(x, F.lit(1), F.length(x) - 1).alias("name"), F.right(x, F.lit(1)).alias("orient")))


def w_walk(text: Column) -> Column:
    """``>1<2`` as (name, orient) structs."""
    return F.transform(F.regexp_extract_all(text, F.lit("[><][^><]+"), F.lit(0)), lambda x: F.struct(F.substr(x, F.lit(2)).alias("name"), F.when(F.left(x, F.lit(1)) == ">", "+").otherwise("-").alias("orient")))


def read_gaf(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """read_id, path_start, path_end, walk and the query positions of a ``qp:B:I`` tag; ``*`` walks are an error."""
    f = _lines(spark, path).select(F.split("value", "\t").alias("f"))
    walk = F.when(F.get("f", 5).rlike("^[><]"), w_walk(F.get("f", 5))).otherwise(p_walk(F.get("f", 5)))
    read = _checked(F.get("f", 0), (F.size("f") >= 12) & (F.get("f", 5) != "*"), "a GAF line needs 12 columns and a walk")
    tag = F.get(F.filter("f", lambda x: F.startswith(x, F.lit("qp:B:I,"))), 0)
    return f.select(read.alias("read_id"), F.get("f", 7).cast("int").alias("path_start"), F.get("f", 8).cast("int").alias("path_end"), walk.alias("walk"), F.transform(F.split(F.substr(tag, F.lit(8)), ","), lambda x: x.cast("int")).alias("query_positions"))


def read_pack(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """node_id and cnt of a pack table; comments and zero counts left out, and of a node that stands twice all but its last line."""
    lines = _lines(spark, path).select("value", F.struct(F.col("_metadata.file_path").alias("p"), F.monotonically_increasing_id().alias("i")).alias("at"))
    f = lines.where("not startswith(value, '#')").select(F.split("value", "\t").alias("f"), "at").select(F.get("f", 0).try_cast("long").alias("node_id"), F.get("f", 1).try_cast("long").alias("cnt"), "at")
    return f.where("node_id is not null").groupBy("node_id").agg(F.max_by("cnt", "at").alias("cnt")).where("cnt > 0")


def read_graphs(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Several GFA files as one graph: ``read_gfa`` of each, its segments named ``number of the file:name``."""
    out: list[DataFrame] | None = None
    for i, path in enumerate(paths):
        own = [F.lit(f"{i}:")]
        segments, links, steps = read_gfa(spark, path)
        named = [
            segments.withColumn("name", F.concat(*own, "name")),
            links.withColumns({c: F.concat(*own, c) for c in ("from_id", "to_id")}),
            steps.withColumn("name", F.concat(*own, "name")),
        ]
        out = named if out is None else [a.unionByName(b) for a, b in zip(out, named)]
    if out is None:
        raise ValueError("no files")
    return tuple(out)


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start, end and grp of a table of partitions: column 4 names a range's group; without it a range is a group of its own."""
    return read_bed(spark, path).withColumnRenamed("name", "grp")


def read_projection(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """A projection bundle as ``writers.write_projection`` leaves it: its manifest and its counts."""
    import json

    manifest = json.loads(spark.read.text(f"{path}/manifest").first()["value"])
    if manifest.get("kind") != "projection":
        raise ValueError(f"{path} is no projection bundle")
    return manifest, spark.read.parquet(f"{path}/counts")


def file_list(listed: str | None, given: list[str], spark: SparkSession) -> list[str]:
    """Paths given one by one or as a list file (``#`` comments), not both; none at all is an error."""
    if listed and given:
        raise ValueError("give a list file or paths, not both")
    if listed:
        return [r["name"] for r in read_names(spark, listed).collect()]
    if not given:
        raise ValueError("no files")
    return given


def format_of(path: str) -> str | None:
    """The alignment format that a file's name tells: paf, 1aln or tpa, or None."""
    bare = path.lower().removesuffix(".gz").removesuffix(".bgz")
    return next((kind for kind in ("paf", "1aln", "tpa") if bare.endswith(f".{kind}")), None)


def read_sequences(spark: SparkSession, paths: list[str]) -> DataFrame:
    """name and seq of FASTA files, all of one kind; a name that stands twice is an error when it is read."""
    kinds = {("fasta" if p.lower().removesuffix(".gz").endswith((".fa", ".fasta", ".fna")) else p.rsplit(".", 1)[-1]) for p in paths}
    if kinds != {"fasta"}:
        raise ValueError(f"sequence files must all be FASTA, not {sorted(kinds)}")
    found = read_fasta(spark, paths).groupBy("name").agg(F.min("seq").alias("seq"), F.count("*").alias("_n"))
    return found.select(_checked(F.col("name"), F.col("_n") == 1, "a sequence's name stands twice").alias("name"), "seq")


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """chrom, pos, ref, alt, sample and gt of each call of one file; the header's sample names are read once."""
    lines = _lines(spark, path)
    head = lines.where("startswith(value, '#CHROM')").limit(1).collect()
    names = head[0]["value"].split("\t")[9:] if head else []
    f = lines.where("not startswith(value, '#')").select(F.split("value", "\t").alias("f"))
    calls = F.arrays_zip(F.array(*map(F.lit, names)).alias("sample"), F.slice("f", 10, len(names)).alias("call")) if names else F.array().cast("array<struct<sample:string,call:string>>")
    each = f.select(F.get("f", 0).alias("chrom"), F.get("f", 1).cast("long").alias("pos"), F.get("f", 3).alias("ref"), F.get("f", 4).alias("alt"), F.explode(calls).alias("c"))
    return each.select("chrom", "pos", "ref", "alt", F.col("c.sample").alias("sample"), F.substring_index("c.call", ":", 1).alias("gt"))


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """A list of names, one a line, ``#`` comments left out; an empty list is an error."""
    names = _lines(spark, path).where("not startswith(trim(value), '#')").select(F.trim("value").alias("name"))
    if names.isEmpty():
        raise ValueError(f"{path} names nothing")
    return names
