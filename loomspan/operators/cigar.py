"""CIGAR arrays: ``array<struct<len:int,op:string>>``, all by higher-order functions inside a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TYPE = "array<struct<len:int,op:string>>"
#: Operations that an alignment may hold.
OPS = ("=", "X", "M", "I", "D")


def parse(text: Column) -> Column:
    """The operations of a CIGAR string; null if it holds anything but =, X, M, I and D."""
    whole = F.regexp_extract_all(text, F.lit(r"([0-9]+)([=XMID])"), F.lit(0))
    ops = F.transform(whole, lambda x: F.struct(F.substr(x, F.lit(1), F.length(x) - 1).cast("int").alias("len"), F.right(x, F.lit(1)).alias("op")))
    return F.when(text.rlike(r"^([0-9]+[=XMID])*$"), ops)


def render(ops: Column) -> Column:
    return F.array_join(F.transform(ops, lambda o: F.concat(o["len"].cast("string"), o["op"])), "")


def invert(ops: Column, strand: Column) -> Column:
    """The same alignment with query and target swapped: I and D change places, and on ``-`` the order turns."""
    swapped = F.transform(ops, lambda o: F.struct(o["len"].alias("len"), F.when(o["op"] == "I", "D").when(o["op"] == "D", "I").otherwise(o["op"]).alias("op")))
    return F.when(strand == "-", F.reverse(swapped)).otherwise(swapped)


def target_delta(o: Column) -> Column:
    return F.when(o["op"] == "I", 0).otherwise(o["len"])


def query_delta(o: Column, strand: Column | None = None) -> Column:
    size = F.when(o["op"] == "D", 0).otherwise(o["len"])
    return size if strand is None else F.when(strand == "-", -size).otherwise(size)


def _total(ops: Column, value) -> Column:
    return F.aggregate(ops, F.lit(0), lambda n, o: n + value(o))


def target_span(ops: Column) -> Column:
    return _total(ops, target_delta)


def query_span(ops: Column) -> Column:
    return _total(ops, query_delta)


def gap_compressed_identity(ops: Column) -> Column:
    """Matches over matches, mismatches and gaps, each gap counting once; 0 for no operations."""
    matches = _total(ops, lambda o: F.when(o["op"].isin("=", "M"), o["len"]).otherwise(0))
    bases = _total(ops, lambda o: F.when(o["op"].isin("=", "M", "X"), o["len"]).otherwise(0))
    gaps = F.size(F.filter(ops, lambda o: o["op"].isin("I", "D")))
    return F.when(bases + gaps > 0, matches / (bases + gaps)).otherwise(F.lit(0.0))


def stats(ops: Column) -> Column:
    """Bases and runs of each kind."""
    def bases(*kinds: str) -> Column:
        return _total(ops, lambda o: F.when(o["op"].isin(*kinds), o["len"]).otherwise(0))
    return F.struct(bases("=", "M").alias("matches"), bases("X").alias("mismatches"), bases("I").alias("inserted"), bases("D").alias("deleted"), F.size(F.filter(ops, lambda o: o["op"].isin("I", "D"))).alias("gaps"))


def compact(ops: Column) -> Column:
    """Neighbours of one kind joined, empty operations left out."""
    def add(done: Column, o: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct((last["len"] + o["len"]).alias("len"), last["op"].alias("op"))))
        return F.when(o["len"] == 0, done).when((F.size(done) > 0) & (last["op"] == o["op"]), joined).otherwise(F.concat(done, F.array(o)))
    return F.aggregate(ops, F.array().cast(TYPE), add)


def project(ops: Column, ts: Column, te: Column, qs: Column, qe: Column, strand: Column, r_start: Column, r_end: Column) -> Column:
    """Clip an alignment to the target range [r_start, r_end): a struct, or null where no query or no target base is left.

    Fields: q_first, q_last (descending on ``-``), t_first, t_last, and the first and last kept
    operation with what is cut off them.  An operation counts if it begins no later than the range
    or the record ends; insertions on either border belong to the range.
    """
    turn = F.when(strand == "-", -1).otherwise(1)
    limit = F.least(te, r_end)
    none = F.lit(None).cast("int")
    start = F.struct(
        ts.cast("int").alias("t"), F.when(strand == "-", qe).otherwise(qs).cast("int").alias("q"), F.lit(0).alias("i"),
        *(none.alias(c) for c in ("q_first", "q_last", "t_first", "t_last", "op_first", "op_last", "cut_first", "cut_last")),
    )

    def step(a: Column, o: Column) -> Column:
        ins, dele, size = o["op"] == "I", o["op"] == "D", o["len"]
        t_end = a["t"] + F.when(ins, 0).otherwise(size)
        begin, end = F.greatest(a["t"], r_start), F.least(t_end, F.when(dele, limit).otherwise(r_end))
        kept = (a["t"] <= limit) & F.when(ins, a["t"] >= r_start).otherwise(begin < end)
        first = kept & a["op_first"].isNull()
        q_begin = F.when(ins | dele, a["q"]).otherwise(a["q"] + turn * (begin - a["t"]))
        q_end = F.when(ins, a["q"] + turn * size).when(dele, a["q"]).otherwise(a["q"] + turn * (end - a["t"]))
        t_begin, t_stop = F.when(ins, a["t"]).otherwise(begin), F.when(ins, a["t"]).otherwise(end)
        return F.struct(
            t_end.cast("int").alias("t"), (a["q"] + F.when(dele, 0).otherwise(turn * size)).cast("int").alias("q"), (a["i"] + 1).alias("i"),
            *(F.when(first, v).otherwise(a[c]).cast("int").alias(c) if now else F.when(kept, v).otherwise(a[c]).cast("int").alias(c) for c, v, now in (
                ("q_first", q_begin, True), ("q_last", q_end, False), ("t_first", t_begin, True), ("t_last", t_stop, False),
                ("op_first", a["i"], True), ("op_last", a["i"], False), ("cut_first", t_begin - a["t"], True), ("cut_last", t_end - t_stop, False),
            )),
        )

    def done(a: Column) -> Column:
        keep = a["op_first"].isNotNull() & (a["q_first"] != a["q_last"]) & (a["t_first"] != a["t_last"])
        return F.when(keep, F.struct(*(a[c].alias(c) for c in ("q_first", "q_last", "t_first", "t_last", "op_first", "op_last", "cut_first", "cut_last"))))

    return F.aggregate(ops, start, step, done)


def clipped(ops: Column, hit: Column) -> Column:
    """The operations that ``project`` kept, the outer ones shortened."""
    n = hit["op_last"] - hit["op_first"] + 1
    return F.transform(F.slice(ops, hit["op_first"] + 1, n), lambda o, i: F.struct(
        (o["len"] - F.when(i == 0, hit["cut_first"]).otherwise(0) - F.when(i == n - 1, hit["cut_last"]).otherwise(0)).cast("int").alias("len"), o["op"].alias("op")))
