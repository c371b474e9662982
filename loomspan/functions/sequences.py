"""Functions of sequences and sequence names, all built in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def reverse_complement(seq: Column) -> Column:
    """Reversed, bases complemented and upper-cased; other letters as they are."""
    return F.reverse(F.translate(seq, "ACGTNacgtn", "TGCANTGCAN"))


def pansn(name: Column) -> Column:
    """sample, hap and contig of ``sample#hap#contig``; null unless all three are there."""
    parts = F.split(name, "#")
    whole = (F.size(parts) == 3) & (F.size(F.filter(parts, lambda p: p == "")) == 0)
    return F.when(whole, F.struct(parts[0].alias("sample"), parts[1].alias("hap"), parts[2].alias("contig")))


def sample_and_haplotype(name: Column) -> Column:
    """``X_hapN`` first, then ``X#N``, otherwise the whole name before a colon."""
    base = F.substring_index(name, ":", 1)
    by_hap, by_hash = r"^(.+)_hap([0-9]+)", r"^([^#]+)#([0-9]+)"
    return F.when(base.rlike(by_hap), F.struct(F.regexp_extract(base, by_hap, 1).alias("sample"), F.regexp_extract(base, by_hap, 2).alias("hap"))).when(
        base.rlike(by_hash), F.struct(F.regexp_extract(base, by_hash, 1).alias("sample"), F.regexp_extract(base, by_hash, 2).alias("hap"))).otherwise(F.struct(base.alias("sample"), F.lit(None).cast("string").alias("hap")))


def group_name(name: Column, delimiter: str, n: int) -> Column:
    """The name up to its n-th delimiter."""
    return F.substring_index(name, delimiter, n)


def region(text: Column) -> Column:
    """name, start and end of ``name:start-end``, split at the last colon; null unless start < end."""
    pattern = r"^(.*):([0-9]+)-([0-9]+)$"
    start, end = (F.regexp_extract(text, pattern, i).try_cast("int") for i in (2, 3))
    return F.when(text.rlike(pattern) & (start < end), F.struct(F.regexp_extract(text, pattern, 1).alias("name"), start.alias("start"), end.alias("end")))


def n_clip(seq: Column, min_run: int) -> Column:
    """(from, to) after runs of N at the ends, of ``min_run`` or more, are left out; null if nothing is left; 0 leaves all."""
    if min_run <= 0:
        return F.struct(F.lit(0).alias("from"), F.length(seq).alias("to"))
    head, tail = F.length(F.regexp_extract(seq, "^[Nn]*", 0)), F.length(F.regexp_extract(seq, "[Nn]*$", 0))
    begin = F.when(head >= min_run, head).otherwise(0)
    end = F.length(seq) - F.when(tail >= min_run, tail).otherwise(0)
    return F.when(begin < end, F.struct(begin.alias("from"), end.alias("to")))


def contig_order(name: Column) -> tuple[Column, Column]:
    """Sort keys that put 1 to 22, X, Y and M first, then names."""
    bare = F.regexp_replace(F.substring_index(name, "#", -1), "^chr", "")
    number = bare.try_cast("int")
    rank = F.when(number.between(1, 22), number).when(bare == "X", 23).when(bare == "Y", 24).when(bare.isin("M", "MT"), 25).otherwise(26)
    return rank, name


def wrapped(seq: Column, width: int = 80) -> Column:
    """FASTA lines of ``width``."""
    return F.regexp_replace(F.regexp_replace(seq, "(.{%d})" % width, "$1\n"), "\n$", "")


def path_name(name: Column, start: Column, end: Column, strand: Column | None = None) -> Column:
    base = F.concat(name, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))
    return base if strand is None else F.concat(base, F.lit("("), strand, F.lit(")"))


def short_number(value: Column) -> Column:
    """Seven decimals, less the zeros at the end."""
    text = F.format_string("%.7f", value.cast("double"))
    return F.regexp_replace(F.regexp_replace(text, "0+$", ""), "\\.$", "")


def subset_keys(name: Column) -> Column:
    """What a name is matched by, from the most to the least particular: itself, itself without coordinates, sample and haplotype, sample.

    Keys of a list entry without a haplotype stand for its whole sample.
    """
    base = F.substring_index(name, ":", 1)
    s = sample_and_haplotype(base)
    both = F.when(s["hap"].isNotNull(), F.concat(F.lit("h|"), s["sample"], F.lit("|"), s["hap"]))
    return F.struct(F.concat(F.lit("n|"), name).alias("name"), F.concat(F.lit("b|"), base).alias("base"), both.alias("hap"), F.concat(F.lit("s|"), s["sample"]).alias("sample"))


def cut_at_n(seq: Column, min_run: int) -> Column:
    """(start, end) of the pieces between runs of N of ``min_run`` or more, as an array."""
    pieces = F.split(seq, f"[Nn]{{{max(1, min_run)},}}", -1)
    runs = F.regexp_extract_all(seq, F.lit(f"[Nn]{{{max(1, min_run)},}}"), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def add(a: Column, p: Column) -> Column:
        end = a["at"] + F.length(p["piece"])
        grown = F.concat(a["out"], F.array(F.struct(a["at"].cast("int").alias("start"), end.cast("int").alias("end"))))
        return F.struct((end + F.coalesce(F.length(p["run"]), F.lit(0))).cast("int").alias("at"), F.when(F.length(p["piece"]) > 0, grown).otherwise(a["out"]).alias("out"))

    return F.aggregate(F.arrays_zip(pieces.alias("piece"), runs.alias("run")), start, add, lambda a: a["out"])
