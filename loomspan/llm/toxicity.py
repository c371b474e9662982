"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Texts are lower-cased and their n-grams of 3 to 5 code points hashed to ``2**BITS`` buckets; a text's
features are its (damped) n-gram frequencies, so that long and short texts compare.  From the labelled sample come,
for each bucket, the smoothed log ratio of its counts in toxic and other texts; the ``FEATURES`` buckets
whose document counts differ most between the classes are kept, scaled by their ratio, and weighed by
logistic regression.  The margin at which a fifth of the sample, left out of the regression, separates best
becomes score 0.7.

The classifier is fitted on a bounded sample of the labelled rows: the ``SAMPLE`` of each class whose
hashed ids are smallest.  Every text is then scored whole, in one pass without a shuffle.

Defined cases: a null or empty text has no features and gets the score of an all-zero row; a null
``doc_id`` is never in the sample, and is scored; repeated rows are scored each; without labels of both classes
every score is 0; other columns pass through ``scored``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.llm import bpe, shared, text_batches

#: Labelled rows of each class at most; buckets' bits; kept buckets; lengths of n-grams; the score from which a text counts as toxic.
SAMPLE, BITS, FEATURES, LENGTHS, TOXIC = 6000, 19, 4096, (3, 4, 5), 0.7
#: n-grams added to each text's count; standard errors that a bucket's shares in the classes differ by at least.
DAMPING, LEAST_Z = 200, 4.0
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1, F.lit(False))


def _buckets(points: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length, the bucket of the n-gram at each position, and whether it stays within its text."""
    low = text_batches.lower_table()[points].astype(np.uint64)
    h, n = low + np.uint64(1), len(low)
    for k in range(2, max(LENGTHS) + 1):
        if n < k:
            return
        h = h[: n - k + 1] * np.uint64(1_000_003) + low[k - 1 :]
        if k in LENGTHS:
            within = np.ones(n - k + 1, bool)
            for back in range(1, k):
                at = bounds[1:-1] - back
                within[at[(at >= 0) & (at < len(within))]] = False
            yield ((h * _SPREAD) >> np.uint64(64 - BITS)).astype(np.int32), within


def _n_grams(bounds: np.ndarray) -> np.ndarray:
    """What counts are divided by: the n-grams of each text, and a few more, so that a chance hit in a short text says little."""
    return sum(np.maximum(np.diff(bounds) - k + 1, 0) for k in LENGTHS) + DAMPING


class Model:
    def __init__(self, buckets: np.ndarray, weights: np.ndarray, bias: float, slope: float = 1.0):
        self.buckets, self.weights, self.bias, self.slope = buckets, weights.astype(np.float32), bias, slope
        self._table: np.ndarray | None = None

    def scores(self, data: bytes, offsets: np.ndarray) -> np.ndarray:
        if self._table is None:
            self._table = np.zeros(1 << BITS, np.float32)
            self._table[self.buckets] = self.weights
        points, bounds = text_batches.code_points(data, offsets)
        total = np.zeros(len(bounds) - 1)
        for bucket, within in _buckets(points, bounds):
            sums = np.concatenate([[0.0], np.cumsum(np.where(within, self._table[bucket], 0), dtype=np.float64)])
            at = np.minimum(bounds, len(sums) - 1)
            total += sums[at[1:]] - sums[at[:-1]]
        margin = self.bias + self.slope * total / _n_grams(bounds)
        return 1 / (1 + np.exp(-np.clip(margin, -700, 700)))


def _labelled_sample(docs: DataFrame, labels: DataFrame, trained_on: Column) -> DataFrame:
    """text and toxic of the sampled labelled rows.  Its ids, 2 * SAMPLE at most, are broadcast."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & trained_on).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = known.withColumn("_h", F.xxhash64("doc_id"))
    ids = [order.where(F.col("toxic") == c).orderBy("_h", "doc_id").limit(SAMPLE) for c in (0, 1)]
    kind = docs.schema["doc_id"].dataType
    chosen = ids[0].unionByName(ids[1]).select(F.col("doc_id").cast(kind).alias("doc_id"), F.col("toxic").cast("int").alias("_toxic"))
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("text", F.col("_toxic").alias("toxic"), (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).alias("apart"))


def fit(docs: DataFrame, labels: DataFrame, trained_on: Column | None = None) -> Model:
    """A model from the labelled rows for which ``trained_on`` (of doc_id) holds; by default those not held out."""
    trained_on = ~held_out(F.col("doc_id")) if trained_on is None else trained_on
    sample = shared.written(_labelled_sample(docs, labels, trained_on), "labelled")
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return Model(np.zeros(0, np.int64), np.zeros(0), -700.0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 1 << BITS), np.int32)
        for batch in batches:
            toxic = batch.column("toxic").to_numpy()
            for a, b, data, offsets in bpe.text_slices(batch.column("text")):
                points, bounds = text_batches.code_points(data, offsets)
                owner, keys = np.repeat(np.arange(b - a), np.diff(bounds)), []
                for bucket, within in _buckets(points, bounds):
                    keys.append(np.unique((owner[: len(bucket)].astype(np.int64) << BITS | bucket)[within]))
                for key in keys:
                    label = toxic[a + (key >> BITS)]
                    for c in (0, 1):
                        seen[c] += np.bincount(key[label == c] & ((1 << BITS) - 1), minlength=1 << BITS).astype(np.int32)
        at = np.flatnonzero(seen.any(axis=0))
        for x in np.array_split(at, max(1, len(at) // 50_000)):
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)), pa.array(seen[0][x]), pa.array(seen[1][x])], ["bucket", "n0", "n1"])

    counts = shared.mapped(sample.select("text", "toxic"), count, "bucket int, n0 int, n1 int").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where("n0 + n1 >= 4")
    r0, r1 = (F.col(f"n{c}") / sizes[c] for c in (0, 1))
    whole = (F.col("n0") + F.col("n1")) / (sizes[0] + sizes[1])
    differ = F.abs(r1 - r0) / F.sqrt(whole * F.greatest(F.lit(1e-4), 1 - whole) + 1e-6)
    spread = (1 / sizes[0] + 1 / sizes[1]) ** 0.5
    ratio = F.log((F.col("n1") + 1) / (sizes[1] + 2)) - F.log((F.col("n0") + 1) / (sizes[0] + 2))
    best = counts.select("bucket", ratio.alias("ratio"), differ.alias("differ")).where(F.col("differ") >= LEAST_Z * spread).orderBy(F.desc("differ"), "bucket").limit(FEATURES).toPandas().sort_values("bucket")
    buckets, ratios = best["bucket"].to_numpy(np.int64), best["ratio"].to_numpy(float)
    place = np.full(1 << BITS, -1, np.int32)
    place[buckets] = np.arange(len(buckets))
    held = docs.sparkSession.sparkContext.broadcast(place)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in bpe.text_slices(batch.column("text")):
                points, bounds = text_batches.code_points(data, offsets)
                owner = np.repeat(np.arange(b - a), np.diff(bounds))
                keys = [np.zeros(0, np.int64)]
                for bucket, within in _buckets(points, bounds):
                    feature = held.value[bucket]
                    on = within & (feature >= 0)
                    keys.append(owner[: len(bucket)][on].astype(np.int64) << 20 | feature[on])
                key, times = np.unique(np.concatenate(keys), return_counts=True)
                row = key >> 20
                size = np.bincount(row, minlength=b - a)
                # Features rise within a row and most counts are 1, so their bytes deflate well.
                parts = (batch.column("toxic").slice(a, b - a).to_numpy().astype("<i4"), batch.column("apart").slice(a, b - a).to_numpy(zero_copy_only=False).astype("<i4"), _n_grams(bounds).astype("<i4"), size.astype("<i4"), np.diff(key & ((1 << 20) - 1), prepend=0).astype("<i4"), times.astype("<i4"))
                planes = [np.ascontiguousarray(p.view(np.uint8).reshape(-1, 4).T).tobytes() for p in parts]
                yield pa.RecordBatch.from_arrays([pa.array([b - a], pa.int32()), pa.array([zlib.compress(b"".join(planes), 1)], pa.binary())], ["n", "packed"])

    y, apart, feature, value, size = _unpacked(shared.mapped(sample, vectors, "n int, packed binary").toArrow())
    scale = 1000.0
    weights, bias = _regress(np.repeat(np.arange(len(size)), size), feature, value * scale * ratios[feature], y, ~apart, len(buckets))
    margin = bias + np.bincount(np.repeat(np.arange(len(size)), size), weights[feature] * ratios[feature] * value * scale, len(size))
    cut = _cut(margin[apart], y[apart]) if len(set(y[apart])) == 2 else _cut(margin, y)
    return Model(buckets, weights * ratios * scale, bias - cut + float(np.log(TOXIC / (1 - TOXIC))))


def _unpacked(table: pa.Table) -> tuple[np.ndarray, ...]:
    """toxic, apart, and the features, values and numbers of features of the sampled rows."""
    found: list[list[np.ndarray]] = []
    for n, packed in zip(table.column("n").to_pylist(), table.column("packed").to_pylist()):
        raw, at, own = np.frombuffer(zlib.decompress(packed), np.uint8), 0, []
        for k in range(6):
            if k == 4:
                n = int(own[3].sum())
            own.append(np.ascontiguousarray(raw[at : at + 4 * n].reshape(4, n).T).view("<i4").ravel().astype(np.int64))
            at += 4 * n
        found.append(own)
    toxic, apart, n_grams, size, _, times = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in range(6))
    # Differences run on from row to row of a slice and begin anew in each.
    feature = np.concatenate([np.cumsum(f[4]) for f in found] or [np.zeros(0, np.int64)])
    return toxic.astype(float), apart.astype(bool), feature, times / np.repeat(n_grams, size), size


def _regress(row: np.ndarray, feature: np.ndarray, value: np.ndarray, y: np.ndarray, use: np.ndarray, n: int, steps: int = 150) -> tuple[np.ndarray, float]:
    """Ridge logistic regression, classes weighing the same, by Adam over all rows."""
    on = use[row]
    row, feature, value = row[on], feature[on], value[on]
    share = np.where(y == 1, 0.5 / max(1, (use & (y == 1)).sum()), 0.5 / max(1, (use & (y == 0)).sum())) * use
    w, b = np.zeros(n), 0.0
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, steps + 1):
        margin = b + np.bincount(row, w[feature] * value, len(y))
        d = (1 / (1 + np.exp(-np.clip(margin, -50, 50))) - y) * share
        g = np.append(np.bincount(feature, d[row] * value, n) + 1e-5 * w, d.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1], b - float(step[-1])
    return w, b


def _cut(margin: np.ndarray, y: np.ndarray) -> float:
    """The margin with the fewest errors, a clean text refused counting as five; amid the widest such gap."""
    order = np.argsort(margin)
    m, t = margin[order], y[order]
    errors = np.append(0, np.cumsum(t == 1)) + 5 * np.append(np.cumsum((t == 0)[::-1])[::-1], 0)
    padded = np.concatenate([[m[0] - 1], m, [m[-1] + 1]])
    width = padded[1:] - padded[:-1]
    width[errors > errors.min()] = -1
    at = int(np.argmax(width))
    return float((padded[at] + padded[at + 1]) / 2)


def scored(docs: DataFrame, model: Model, score: str = "score") -> DataFrame:
    """``docs`` with each text's score."""
    names = [c for c in docs.columns if c != score]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names) + f", `{score}` double"
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in bpe.text_slices(batch.column("text")):
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in names), pa.array(held.value.scores(data, offsets))], [*names, score])

    return shared.mapped(docs.select(*(f"`{c}`" for c in names)), run, schema)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    found = scored(docs.select("doc_id", "text"), fit(docs, labels))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))
