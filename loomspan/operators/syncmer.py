"""Closed syncmers: extraction, dictionary, walks, anchors, chains and maximal exact walk matches.

A k-mer is a closed syncmer if its least s-mer (in alphabetical order, first of equals) is at either end.
k-mers with another letter than A, C, G and T don't count.  A k-mer and its reverse complement are one node, named by the lesser.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.operators import graph, intervals


def density(w: int) -> float:
    """Expected share of closed syncmers among k-mers of w + 1 s-mers."""
    return 2 / (w + 1)


#: Positions of a sequence that are looked at together.
PIECE = 1 << 18


def _syncmers(seq: bytes, k: int, s: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(positions, canonical k-mers, orientations) of a sequence's syncmers, a piece of the sequence at a time."""
    codes = np.full(256, 4, np.uint8)
    codes[list(b"ACGT")] = np.arange(4, dtype=np.uint8)
    turned = np.arange(256, dtype=np.uint8)
    turned[list(b"ACGT")] = list(b"TGCA")
    raw, w = np.frombuffer(seq, np.uint8), k - s + 1
    for begin in range(0, len(raw) - k + 1, PIECE):
        own = raw[begin : begin + PIECE + k - 1]
        n = len(own) - k + 1
        base = codes[own].astype(np.int64)
        bad = np.concatenate([[0], np.cumsum(base == 4)])
        whole = bad[k:] == bad[: n]
        if s <= 31:  # s-mers as numbers in alphabetical order
            smer = np.zeros(n + w - 1, np.int64)
            for j in range(s):
                smer = smer * 4 + np.minimum(base[j : j + n + w - 1], 3)
        else:
            rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(own, s)).view(f"S{s}").ravel()
            smer = np.unique(rows, return_inverse=True)[1].astype(np.int64)
        least = smer[:n].copy()
        for j in range(1, w):
            np.minimum(least, smer[j : j + n], out=least)
        # The first of equal least s-mers is at the front, or none but the last reaches it.
        inner = np.full(n, np.iinfo(np.int64).max)
        for j in range(w - 1):
            np.minimum(inner, smer[j : j + n], out=inner)
        at = np.flatnonzero(whole & ((smer[:n] == least) | (inner > least)))
        if not len(at):
            continue
        mers = own[at[:, None] + np.arange(k)]
        back = turned[mers[:, ::-1]]
        forward = np.ascontiguousarray(mers).view(f"S{k}").ravel() <= np.ascontiguousarray(back).view(f"S{k}").ravel()
        yield begin + at, np.ascontiguousarray(np.where(forward[:, None], mers, back)), np.where(forward, 1, -1)


def extract(sequences: DataFrame, k: int, s: int, key: str = "path_id", seq: str = "seq") -> DataFrame:
    """key, pos, kmer (canonical), orient and step of each syncmer of each sequence, in time linear in its length."""
    kind = sequences.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            rows = 0
            for i, text in enumerate(batch.column(seq).to_pylist()):
                step = 0
                for at, mers, orient in _syncmers((text or "").encode("ascii", "replace"), k, s):
                    held.append((i, at, mers, orient, step))
                    step, rows = step + len(at), rows + len(at)
                    if rows >= PIECE:
                        yield packed(batch, held)
                        held, rows = [], 0
            if held:
                yield packed(batch, held)

    def packed(batch: pa.RecordBatch, held: list[tuple]) -> pa.RecordBatch:
        n = [len(h[1]) for h in held]
        mers = np.concatenate([h[2].reshape(-1, k) for h in held])
        text = pa.StringArray.from_buffers(len(mers), pa.py_buffer((np.arange(len(mers) + 1) * k).astype(np.int32)), pa.py_buffer(mers.tobytes()))
        return pa.RecordBatch.from_arrays(
            [batch.column(key).take(pa.array(np.repeat([h[0] for h in held], n).astype(np.int64))), pa.array(np.concatenate([h[1] for h in held]).astype(np.int32)), text,
             pa.array(np.concatenate([h[3] for h in held]).astype(np.int32)), pa.array(np.concatenate([h[4] + np.arange(len(h[1])) for h in held]).astype(np.int32))],
            [key, "pos", "kmer", "orient", "step"])

    return sequences.select(key, seq).mapInArrow(run, f"`{key}` {kind}, pos int, kmer string, orient int, step int")


def dictionary(found: DataFrame) -> DataFrame:
    """node_id (from 1, in order of k-mers) and kmer."""
    return graph.ordered(found.select("kmer").distinct(), "kmer", index="_ord").select((F.col("_ord") + 1).alias("node_id"), "kmer")


def frequent_nodes(walk: DataFrame, fraction: float, node: str = "node_id") -> DataFrame:
    """The ``fraction`` of nodes (rounded down) with most occurrences, ties to the lesser id."""
    counts = walk.groupBy(node).agg(F.count("*").alias("n"))
    most = int(counts.count() * fraction)
    return counts.orderBy(F.desc("n"), node).limit(most).select(node)


def occurring_over(walk: DataFrame, most: int, node: str = "kmer") -> DataFrame:
    """Nodes of more than ``most`` occurrences."""
    return walk.groupBy(node).agg(F.count("*").alias("n")).where(F.col("n") > most).select(node)


def anchors(queries: DataFrame, walk: DataFrame, node: str = "kmer", masked: DataFrame | None = None) -> DataFrame:
    """q_id, t_id, strand, q_pos, t_pos of shared nodes, one for each node, strand and diagonal; a path isn't matched with itself.

    ``masked`` (node) are left out, as a node of n occurrences has n^2 pairs: ``frequent_nodes`` or ``occurring_over`` name them.
    """
    if masked is not None:
        queries = queries.join(masked.select(node), node, "left_anti")
    q = queries.select(F.col("path_id").alias("q_id"), F.col(node).alias("_qn"), F.col("pos").alias("q_pos"), F.col("orient").alias("_qo"))
    t = walk.select(F.col("path_id").alias("t_id"), F.col(node).alias("_tn"), F.col("pos").alias("t_pos"), F.col("orient").alias("_to"))
    met = q.join(t, F.col("_qn") == F.col("_tn")).where("q_id <> t_id")
    strand = F.when(F.col("_qo") == F.col("_to"), "+").otherwise("-")
    diagonal = F.when(F.col("_qo") == F.col("_to"), F.col("t_pos") - F.col("q_pos")).otherwise(F.col("t_pos") + F.col("q_pos"))
    placed = met.select("q_id", "t_id", strand.alias("strand"), diagonal.alias("diag"), F.col("_qn").alias("node"), "q_pos", "t_pos")
    return placed.groupBy("q_id", "t_id", "strand", "diag", "node").agg(F.min(F.struct("q_pos", "t_pos")).alias("a")).select("q_id", "t_id", "strand", "diag", F.col("a.q_pos").alias("q_pos"), F.col("a.t_pos").alias("t_pos"))


def chains(found: DataFrame, k: int, gap: int, min_anchors: int = 1) -> DataFrame:
    """Anchors of one pair and strand joined where they follow within ``gap`` on the query: q and t spans and the anchors' number."""
    spans = found.select("q_id", "t_id", "strand", F.col("q_pos").alias("q_start"), (F.col("q_pos") + k).alias("q_end"), "t_pos")
    joined = intervals.merge(spans, ["q_id", "t_id", "strand"], "q_start", "q_end", gap, extra=(F.min("t_pos").alias("t_start"), (F.max("t_pos") + k).alias("t_end")))
    return joined.where(F.col("n_merged") >= min_anchors).withColumnRenamed("n_merged", "n_anchors")


def walk_matches(queries: DataFrame, walk: DataFrame, min_steps: int = 2, node: str = "kmer") -> DataFrame:
    """Maximal runs of steps that two walks share in one direction with equal distances: q_id, t_id, q_step, t_step, steps, q_pos."""
    q = queries.select(F.col("path_id").alias("q_id"), F.col(node).alias("_qn"), F.col("orient").alias("_qo"), F.col("pos").alias("q_pos"), F.col("step").alias("q_step"))
    t = walk.select(F.col("path_id").alias("t_id"), F.col(node).alias("_tn"), F.col("orient").alias("_to"), F.col("pos").alias("t_pos"), F.col("step").alias("t_step"))
    met = q.join(t, (F.col("_qn") == F.col("_tn")) & (F.col("_qo") == F.col("_to"))).where("q_id <> t_id")
    line = met.withColumns({"_d": F.col("t_pos") - F.col("q_pos"), "_e": F.col("t_step") - F.col("q_step")})
    order = Window.partitionBy("q_id", "t_id", "_d", "_e").orderBy("q_step")
    runs = line.withColumn("_run", F.col("q_step") - F.row_number().over(order)).groupBy("q_id", "t_id", "_d", "_e", "_run").agg(F.min("q_step").alias("q_step"), F.min("t_step").alias("t_step"), F.min("q_pos").alias("q_pos"), F.count("*").alias("steps"))
    return runs.where(F.col("steps") >= min_steps).select("q_id", "t_id", "q_step", "t_step", "steps", "q_pos")


def least_anchors(length: Column, w: int, identity: float, syncmer: int, requested: int) -> Column:
    """Anchors that a chain over ``length`` bases needs: a tenth of those expected to survive, at least 1, at most what was asked."""
    expected = F.ceil(length * density(w) * identity**syncmer * 0.10)
    return F.least(F.lit(requested), F.greatest(F.lit(1), expected))
