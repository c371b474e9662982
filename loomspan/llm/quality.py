"""Quality rules: an isolation forest on each text's rule statistics.

One pass over the texts gives each document's statistics; everything after it reads that small table.
Documents that fail the base rules are out.  For the others a forest of random splits, which holds all
labelled rows of good quality, measures how few splits isolate a document; the path length at which a
document counts as anomalous is calibrated on the labelled rows: the threshold that removes most poor rows
while it removes at most ``CLEAN_LOSS`` of the good ones, and is worth it.

The forest and the threshold come from all labelled rows: splits are random in the box of the good rows, every
tree counts all good rows in its leaves, and each labelled row's score is a place to cut.  Only the box, the leaves'
counts and the best cut reach the driver.  Statistics and verdicts cover all documents and whole texts.

Defined cases: a null or empty text has no words and fails the base rules; a null ``doc_id`` is judged but
never fitted on; repeated rows are judged each; without labels only the base rules decide; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm import bpe, shared, text_batches

#: Trees; their depth; share of good rows that may be lost; words of a window.
TREES, DEPTH, CLEAN_LOSS, WINDOW = 200, 8, 0.002, 5
SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_digits")


def _repeats(code: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each word, whether it is in a window found twice or more in its text."""
    n = len(code) - WINDOW + 1
    if n < 1:
        return np.zeros(len(code), bool)
    with np.errstate(over="ignore"):
        h = owner[:n].astype(np.uint64)
        for k in range(WINDOW):
            h = (h ^ code[k : n + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    inside = np.flatnonzero(owner[:n] == owner[WINDOW - 1 :])
    order = inside[np.argsort(h[inside], kind="stable")]
    a, b = order[:-1], order[1:]
    same = (h[a] == h[b]) & (owner[a] == owner[b])
    for k in range(WINDOW):
        same[same] = code[a[same] + k] == code[b[same] + k]
    starts = np.zeros(len(code) + 1, np.int64)
    np.add.at(starts, np.unique(np.concatenate([a[same], b[same]])), 1)
    held = np.cumsum(starts[:-1])
    return held > np.concatenate([np.zeros(WINDOW, np.int64), held[:-WINDOW]])


def _per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def text_counts(data: bytes, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """``COUNTS`` of each of the concatenated texts."""
    n = len(offsets) - 1
    raw = np.frombuffer(data, np.uint8)
    begins, ends, words = text_batches.ascii_words(data, offsets)
    if not len(begins):
        return {c: np.zeros(n, np.int64) for c in COUNTS}
    code, distinct = text_batches.coded(data, begins, ends)
    owner = np.repeat(np.arange(n), np.diff(words))
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    table = np.zeros(256, bool)
    table[list(SYMBOLS)] = True
    pairs = np.unique(owner * len(distinct) + code)
    # Lines: equal to an earlier one of the same text, and with a word.
    cut = raw == 10
    first = np.zeros(len(raw), bool)
    first[offsets[:-1][offsets[:-1] < len(raw)]] = True
    first[1:] |= cut[:-1]
    line_from = np.flatnonzero(first)
    line_to = np.append(line_from[1:], len(raw))
    line_to = line_to - (cut[line_to - 1] & (line_to > line_from))
    has_word = np.searchsorted(begins, line_to) > np.searchsorted(begins, line_from)
    line_from, line_to = line_from[has_word], line_to[has_word]
    line_code, lines = text_batches.coded(data, line_from, line_to)
    line_owner = np.searchsorted(offsets, line_from, "right") - 1
    _, once = np.unique(line_owner * len(lines) + line_code, return_index=True)
    dup = np.ones(len(line_from), bool)
    dup[once] = False
    return dict(zip(COUNTS, (
        np.diff(words),
        _per_text(((raw & 0xC0) != 0x80) & ~space, offsets),
        _per_text(table[raw], offsets),
        np.bincount(line_owner[dup], minlength=n),
        np.bincount(owner[_repeats(code, owner)], minlength=n),
        np.bincount(line_owner, minlength=n),
        np.bincount(pairs // len(distinct), minlength=n),
        _per_text((raw >= 48) & (raw <= 57), offsets),
    )))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of every row, by one pass over the texts."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in bpe.text_slices(batch.column("text")):
                counts = text_counts(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *(pa.array(counts[c].astype(np.int64)) for c in COUNTS)], ["doc_id", *COUNTS])

    return shared.mapped(docs.select("doc_id", F.col("text").cast("string").alias("text")), run, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS))


def features(counts: pd.DataFrame) -> np.ndarray:
    c = {k: counts[k].to_numpy(float) for k in COUNTS}
    words, chars, lines = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1), np.maximum(c["n_lines"], 1)
    return np.column_stack([np.log1p(c["n_words"]), chars / words, c["n_symbols"] / chars, c["n_dup_lines"] / lines, c["n_repeat_words"] / words, np.log(words / lines), np.log(np.maximum(c["n_distinct"], 1)) / np.log1p(words), c["n_digits"] / chars])


class Forest:
    """Isolation trees as flat arrays: feature (-1 at leaves), split, and for leaves the path length."""

    def __init__(self, low: np.ndarray, high: np.ndarray, seed: int = 7):
        """Splits range over the box of the node, which at the root is somewhat wider than the rows, so empty sides count as anomalous."""
        random, margin = np.random.default_rng(seed), 0.25 * (high - low) + 1e-3
        self.trees = [self._grow(random, low - margin, high + margin) for _ in range(TREES)]
        self.usual = 0.0

    @staticmethod
    def _mean_path(n: np.ndarray) -> np.ndarray:
        more = np.maximum(n, 3)
        return np.where(n < 2, 0.0, np.where(n > 2, 2 * (np.log(more - 1) + 0.5772156649) - 2 * (more - 1) / more, 1.0))

    @staticmethod
    def _grow(random: np.random.Generator, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
        size = 2 ** (DEPTH + 1) - 1
        feature, split, path = np.full(size, -1, np.int8), np.zeros(size), np.zeros(size)
        boxes = [(low, high)]
        for at in range(2**DEPTH - 1):
            a, b = boxes[at]
            k = int(random.integers(len(low)))
            x = a[k] + random.random() * (b[k] - a[k])
            feature[at], split[at] = k, x
            lower, upper = b.copy(), a.copy()
            lower[k] = upper[k] = x
            boxes += [(a, lower), (upper, b)]
        return feature, split, path

    def counts(self, rows: np.ndarray) -> np.ndarray:
        """How many rows are in each leaf at full depth, tree after tree."""
        every, found = np.arange(len(rows)), []
        for feature, split, _ in self.trees:
            at = np.zeros(len(rows), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (rows[every, feature[at]] >= split[at])
            found.append(np.bincount(at - (2**DEPTH - 1), minlength=2**DEPTH))
        return np.concatenate(found)

    def settle(self, counts: np.ndarray) -> None:
        """Nodes of fewer than two rows become leaves; paths follow the rows that leaves hold."""
        level = np.floor(np.log2(np.arange(1, 2 ** (DEPTH + 1))))
        for i, leaves in enumerate(counts.reshape(TREES, -1)):
            held = [leaves]
            while len(held[0]) > 1:
                held.insert(0, held[0].reshape(-1, 2).sum(axis=1))
            n, (feature, split, path) = np.concatenate(held), self.trees[i]
            path[:] = level + self._mean_path(n)
            feature[n < 2] = -1
        self.usual = float(self._mean_path(counts[: 2**DEPTH].sum()))

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly of each row, 0 to 1."""
        total, every = np.zeros(len(rows)), np.arange(len(rows))
        for feature, split, path in self.trees:
            at = np.zeros(len(rows), np.int64)
            while True:
                k = feature[at]
                inner = k >= 0
                if not inner.any():
                    break
                at = np.where(inner, 2 * at + 1 + (rows[every, np.maximum(k, 0)] >= split[at]), at)
            total += path[at]
        return 2.0 ** (-total / len(self.trees) / max(self.usual, 1e-9))


def base_failed(counts: pd.DataFrame) -> np.ndarray:
    return ((counts["n_words"] < 10) | (100 * counts["n_repeat_words"] > 20 * counts["n_words"])).to_numpy(bool)


def fit(stats: DataFrame, labels: DataFrame) -> tuple[Forest, float] | None:
    """The forest and the threshold above which a row is anomalous, from all labelled rows; None without enough good ones."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = shared.written(stats.join(known, "doc_id").select("quality", *COUNTS), "labelled")

    def boxes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f = f[~base_failed(f)]
            x = features(f[f["quality"] == 1])
            if len(x):
                yield pd.DataFrame({"i": range(x.shape[1]), "low": x.min(axis=0), "high": x.max(axis=0), "n": len(x)})

    box = rows.mapInPandas(boxes, "i int, low double, high double, n long").groupBy("i").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).orderBy("i").toPandas()
    if not len(box) or box["n"][0] < 20:
        shared.dropped(rows)
        return None
    forest = Forest(box["low"].to_numpy(), box["high"].to_numpy())

    def leaves(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros(TREES * 2**DEPTH, np.int64)
        for f in frames:
            f = f[~base_failed(f)]
            held += forest.counts(features(f[f["quality"] == 1]))
        at = np.flatnonzero(held)
        yield pd.DataFrame({"leaf": at, "n": held[at]})

    found = rows.mapInPandas(leaves, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(TREES * 2**DEPTH, np.int64)
    counts[found["leaf"].to_numpy()] = found["n"].to_numpy()
    forest.settle(counts)

    def scores(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f = f[~base_failed(f)]
            yield pd.DataFrame({"score": forest.scores(features(f)), "good": (f["quality"] == 1).astype(np.int64).to_numpy()})

    scored = rows.mapInPandas(scores, "score double, good long").groupBy("score").agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("poor"))
    scored = shared.written(scored, "scored")
    # Each place to cut: all above it go.
    all_ = scored.agg(F.sum("good").alias("good"), F.sum("poor").alias("poor")).first()
    above = shared.running(scored, [F.desc("score")], {"_good": F.col("good"), "_poor": F.col("poor")})
    lost, gone = F.col("_good") / all_["good"], F.col("_poor") / max(1, all_["poor"])
    cut = above.where(lost <= CLEAN_LOSS).orderBy((gone - 5 * lost).desc(), F.desc("score")).first()["score"]
    least = scored.where(F.col("score") > cut).agg(F.min("score")).first()[0]
    shared.dropped(rows, scored)
    return forest, float((cut + (1.0 if least is None else least)) / 2)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, anomaly and kept of every row."""
    stats = shared.written(statistics(docs), "statistics")
    model = docs.sparkSession.sparkContext.broadcast(fit(stats, labels))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            failed = base_failed(f)
            anomaly = np.zeros(len(f)) if model.value is None else model.value[0].scores(features(f))
            kept = ~failed & (anomaly <= (1.0 if model.value is None else model.value[1]))
            yield f.assign(base_failed=failed, anomaly=anomaly, kept=kept)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return stats.mapInPandas(run, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, anomaly double, kept boolean")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judged(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")
