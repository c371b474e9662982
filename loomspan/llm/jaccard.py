"""N-gram Jaccard join: a size-aware heavy-light join of the documents' word-shingle sets.

Documents of one set are collapsed first (J = 1).  Of the distinct sets, *light* ones, up to a boundary
size, list every 2-subset of a prefix of their shingles; *heavy* ones scan inverted lists of single prefix
shingles, in which the light sets that can reach a heavy one stand too.  Prefixes are those of the prefix
filter (two sets that reach the threshold share k shingles of their prefixes of size
``n - ceil(0.8 n) + k``), in one global order: rare shingles by hash, then frequent ones by hash.  Frequent
are those that most sets share: each task counts all shingles of the distinct sets that it reads, and the counts of all
tasks are added.  (Counts over prefixes by hash alone would leave most of what a large group shares among the rare ones.)  Which shingles count as frequent changes the work, never the result.  The boundary is the size at which the
measured numbers of subsets and of list entries to be met cost least together.

Lists don't emit all their pairs.  Each list's members of like size are compared with one of them (a
star, whose centre is the set that meets most others); the links found are closed to components.  Then only pairs of one list that are in different
components are compared too, less those that sizes, positions, bitmaps or the triangle inequality through the
star's centre rule out; long lists are gone through in blocks, those of a list that has many outside its
largest component by several tasks.  So each pair that could link is compared or is already connected, and a group
of copies costs rows in proportion to its size.

Pairs are first held against bitmaps: a set's bitmap has a bit for each shingle or so, turned over by every
shingle that falls on it, so two bitmaps differ in no more bits than the sets do in shingles.  Only pairs that
this bound lets link have their sets fetched and compared exactly, on 64-bit shingle hashes.  A set's id is 64 bits of the hash of its shingles;
if another 64 bits show two sets with one id, all ids are drawn anew with another salt.

Defined cases: a null text, or one without words, has an empty set and links with nothing; fewer than five
words are one shingle of them all; equal rows are in one component; a null ``doc_id`` takes part, and is not
a component's id if it has another; an empty table gives an empty result; other columns are ignored by
``linked`` and pass through ``deduplicated``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.llm import bpe, components, shared, text_batches

WORDS, PERCENT = 5, 80
#: Shingles that a task looks at together; sets among them that make a shingle a candidate for frequent, and sets in all; frequent shingles at most.
WINDOW_KEYS, WINDOW_TIMES, TIMES, MOST_FREQUENT = 4 << 20, 2, 12, 500_000
#: Rows that comparing one candidate costs; entries of a list that is taken in one row; members of a block, and the shingles of its sets together; blocks of strays that one task meets with a list; ratio of the sizes of a class.
COMPARING, SHORT_LIST, BLOCK, BLOCK_SHINGLES, STRAY_BLOCKS, SIZE_CLASS = 20, 32, 256, 1 << 20, 4, 1.05
#: Sizes up to which a boundary is looked for; rows up to which chosen row numbers are broadcast.
MOST_BOUNDARY, BROADCAST_ROWS = 128, 500_000
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _K2
    return x ^ (x >> np.uint64(29))


def _needed(n: np.ndarray | int) -> np.ndarray | int:
    """Shingles that a set of n shares with any that links with it, at least."""
    return -(-PERCENT * n // 100)


def shingle_sets(data: bytes, offsets: np.ndarray) -> list[np.ndarray]:
    """The ascending distinct 64-bit shingle hashes of each text."""
    import xxhash

    raw = np.frombuffer(data, np.uint8)
    low = raw | (((raw >= 65) & (raw <= 90)).astype(np.uint8) << 5)
    data = low.tobytes()
    begins, ends, words = text_batches.ascii_words(data, offsets)
    if not len(begins):
        return [np.zeros(0, np.uint64)] * (len(offsets) - 1)
    code, distinct = text_batches.coded(data, begins, ends)
    digest = xxhash.xxh3_64_intdigest
    word = np.fromiter((digest(w) for w in distinct.to_pylist()), np.uint64, len(distinct))[code]
    n = len(word) - WORDS + 1
    hashed = np.zeros(max(n, 0), np.uint64)
    for k in range(WORDS if n > 0 else 0):
        hashed = _mixed(hashed * _K1 + word[k : n + k])
    out = []
    for a, b in zip(words[:-1].tolist(), words[1:].tolist()):
        if b - a >= WORDS:
            out.append(np.unique(hashed[a : b - WORDS + 1]))
        elif b > a:
            h = np.full(1, b - a, np.uint64)
            for w in word[a:b]:
                h = _mixed(h * _K1 + w + np.uint64(1))
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def bitmaps(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parities of a set's shingles over 2^k ranges of hashes, 2^k >= size, and over half as many, in words of 64."""
    k = max(6, int(len(s) - 1).bit_length())
    odd = (np.bincount((s >> np.uint64(64 - k)).astype(np.int64), minlength=1 << k) & 1).astype(np.uint8)
    half = odd.reshape(-1, 2).sum(axis=1).astype(np.uint8) & 1 if k > 6 else odd
    return np.packbits(odd).view(np.int64), np.packbits(half).view(np.int64)


def _signature(s: np.ndarray, salt: int) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16, salt=salt.to_bytes(8, "little")).digest()


def _prefix(n: int) -> int:
    """Shingles of a set of n that are looked at first."""
    return n - int(_needed(n)) + 2


class _Counts:
    """How many distinct sets of a task have each shingle, in their prefix by hash or anywhere, a window of sets at a time."""

    def __init__(self, whole: bool = False) -> None:
        self.whole = whole
        self.seen: set[bytes] = set()
        self.parts: list[np.ndarray] = []
        self.held = 0

    def add(self, s: np.ndarray, name: bytes) -> None:
        if len(s) >= 4 and name not in self.seen:
            self.seen.add(name)
            self.parts.append(s if self.whole else s[: _prefix(len(s))].copy())
            self.held += len(self.parts[-1])

    def repeated(self) -> tuple[np.ndarray, np.ndarray]:
        """Shingles of several sets of the window and their numbers; a new window begins."""
        each, times = np.unique(np.concatenate(self.parts), return_counts=True) if self.parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.__init__(self.whole)
        often = times >= WINDOW_TIMES
        return each[often].view(np.int64), times[often]


def _digests(docs: DataFrame, salt: int) -> DataFrame:
    """_rid, doc_id, n, set_id, check and bitmaps of every row; rows with n = -1 have shingles that repeat in a window of a task, and how often."""
    kind = docs.schema["doc_id"].dataType
    names = ["_rid", "doc_id", "n", "set_id", "check", "often", "times", "map", "half"]

    def told(counts: _Counts, doc_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        each, times = counts.repeated()
        for part in np.array_split(np.arange(len(each)), -(-len(each) // 50_000)) if len(each) else ():
            lists = [pa.array([x[part]], pa.list_(pa.int64())) for x in (each, times)]
            none = [pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.nulls(1, doc_type), pa.array([-1], pa.int64()), *none[:2], *lists, *none[2:]], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, doc_type = _Counts(whole=True), None
        for batch in batches:
            doc_type = batch.column("doc_id").type
            for a, b, data, offsets in bpe.text_slices(batch.column("text")):
                sets = shingle_sets(data, offsets)
                signs = [_signature(s, salt) for s in sets]
                ids = np.frombuffer(b"".join(signs), np.int64).reshape(-1, 2)
                for s, sign in zip(sets, signs):
                    counts.add(s, sign)
                maps, none = [bitmaps(s) for s in sets], pa.nulls(b - a, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_rid").slice(a, b - a), batch.column("doc_id").slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids[:, 0]), pa.array(ids[:, 1]), none, none,
                     *(pa.array([m[i] for m in maps], pa.list_(pa.int64())) for i in (0, 1))], names)
                if counts.held >= WINDOW_KEYS:
                    yield from told(counts, doc_type)
        if counts.held:
            yield from told(counts, doc_type)

    return shared.mapped(docs.select("_rid", "doc_id", F.col("text").cast("string").alias("text")), run, f"_rid long, doc_id {kind.simpleString()}, n long, set_id long, check long, often array<long>, times array<long>, map array<long>, half array<long>")


def boundary(sizes: dict[int, int], heavier: int, met: float) -> int:
    """The size up to which sets are light, by cost.

    sizes: how many sets have each size up to ``MOST_BOUNDARY``; heavier: the rest; met: the share of list
    entries that repeat, hence meet others.  A 2-subset costs a row; a list entry costs a row and comparing what it meets.
    """
    def cost(b: int) -> float:
        total = 0.0
        for n, times in sizes.items():
            prefix = n - _needed(n)
            if n <= b:
                total += times * (prefix + 2) * (prefix + 1) / 2
            if n > b or 100 * n >= PERCENT * (b + 1):
                total += times * (prefix + 1) * (1 + COMPARING * met)
        return total

    return min(range(0, MOST_BOUNDARY + 1), key=lambda b: (cost(b), b))


def _keys(s: np.ndarray, frequent: np.ndarray, light: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys under which a set is found, and for each the size of the largest set that it can link with if they share nothing before it."""
    n = len(s)
    if n < 4:  # no other set reaches 80 % of so few
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    prefix = n - int(_needed(n))
    first = s[: prefix + 2]
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
        common = frequent[at] == s
        if common[: prefix + 2].any():
            first = np.concatenate([s[~common], s[common]])[: prefix + 2]
    keys, reach = [], []
    if n <= light:
        i, j = np.triu_indices(len(first), 1)
        a, b = np.minimum(first[i], first[j]), np.maximum(first[i], first[j])
        keys.append(_mixed(_mixed(a + _K2) * _K1 + b))
        reach.append(np.full(len(i), 100 * n // PERCENT))
    if n > light or 100 * n >= PERCENT * (light + 1):
        keys.append(first[: prefix + 1])
        # Linking sets share PERCENT / (100 + PERCENT) of both sizes, and what is left from here on at most.
        reach.append(np.minimum(100 * n // PERCENT, (100 + PERCENT) * (n - np.arange(len(keys[-1]))) // PERCENT - n))
    return np.concatenate(keys), np.concatenate(reach).astype(np.int32)


def _postings(docs: DataFrame, salt: int, frequent: np.ndarray, light: int) -> DataFrame:
    """key, n, set_id and reach, for the sets of each task, once for each set."""
    held = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for _, _, data, offsets in bpe.text_slices(batch.column("text")):
                found = []
                for s in shingle_sets(data, offsets):
                    name = _signature(s, salt)
                    if len(s) >= 4 and name not in seen:
                        seen.add(name)
                        found.append((len(s), int.from_bytes(name[:8], "little", signed=True), *_keys(s, held.value, light)))
                if found:
                    times = [len(f[2]) for f in found]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate([f[2] for f in found]).view(np.int64)), pa.array(np.repeat(np.array([f[0] for f in found], np.int32), times)),
                         pa.array(np.repeat(np.array([f[1] for f in found], np.int64), times)), pa.array(np.concatenate([f[3] for f in found]))],
                        ["key", "n", "set_id", "reach"],
                    )

    return shared.mapped(docs.select(F.col("text").cast("string").alias("text")), run, "key long, n int, set_id long, reach int")


def _stars(postings: DataFrame) -> DataFrame:
    """key, a, b, n, reach, and whether the list has three sets or more, of each member b of a list of two or more; a is the centre it is compared with.

    Lists are read in order, so a task holds one entry of a list and no more.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None
        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "n", "set_id", "reach", "times")]
            columns[4] = columns[4].astype(np.int64)
            key, n, sid, reach, times = columns
            keep = np.ones(len(key), bool)
            keep[1:] = (key[1:] != key[:-1]) | (sid[1:] != sid[:-1])
            key, n, sid, reach, times = (c[keep] for c in columns)
            if not len(key):
                continue
            new = np.append(True, key[1:] != key[:-1])
            if carry is not None and carry[0] == key[0]:
                new[0] = False
            heads = np.flatnonzero(new)
            centre, centre_n = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
            run_of = np.cumsum(new) - 1
            if len(heads):
                at = np.maximum(run_of, 0)
                centre, centre_n = sid[heads][at], n[heads][at].astype(np.int64)
            if not new[0]:
                centre[run_of < 0], centre_n[run_of < 0] = carry[1], carry[2]
            # Sets of a size that can't link with the first of their list start a star of their own.
            far = np.flatnonzero((PERCENT * n.astype(np.int64) > 100 * centre_n) | (100 * n.astype(np.int64) < PERCENT * centre_n))
            last_key, own, own_n = None, 0, 0
            if len(far) and carry is not None and carry[0] == key[far[0]]:
                last_key, own, own_n = carry[0], carry[3], carry[4]
            for i in far.tolist():
                if key[i] != last_key or PERCENT * int(n[i]) > 100 * own_n or 100 * int(n[i]) < PERCENT * own_n:
                    last_key, own, own_n = key[i], int(sid[i]), int(n[i])
                centre[i], centre_n[i] = own, own_n
            head = (carry[1], carry[2]) if run_of[-1] < 0 else (int(sid[heads[-1]]), int(n[heads[-1]]))
            carry = (key[-1], *head, int(centre[-1]), int(centre_n[-1]))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(centre), pa.array(sid), pa.array(n.astype(np.int32)), pa.array(reach), pa.array(times >= 3)], ["key", "a", "b", "n", "reach", "open"])

    return shared.mapped(postings, run, "key long, a long, b long, n int, reach int, open boolean")


def _lists(postings: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The entries of lists with two sets or more, list after list, in each the sets first that meet most others; and the tables behind them.

    A copied original shares its rare shingles with all copies, a copy only those it left unchanged, so the
    original comes to be the centre that its copies are compared with.
    """
    held = shared.written(postings.withColumn("times", F.count("*").over(Window.partitionBy("key"))).where("times > 1"), "lists")
    shared.released(postings.sparkSession)
    met = shared.written(held.groupBy("set_id").agg(F.sum("times").alias("met")), "met")
    ranked = held.join(met, "set_id").repartition("key").sortWithinPartitions("key", F.desc("met"), "n", "set_id")
    return ranked.select("key", "n", "set_id", "reach", "times"), [held, met]


def _bounded(pairs: DataFrame, digests: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, both (sizes added) and apart, the shingles that are in one of them only at least."""
    ends = pairs.select(F.col("a").alias("set_id")).unionByName(pairs.select(F.col("b").alias("set_id"))).distinct()
    rows = ends.join(sets.select("set_id", "_rid"), "set_id").join(digests.select("_rid", "n", "map", "half"), "_rid").drop("_rid")
    marks = shared.written(rows, "marks")
    x, y = (marks.select(F.col("set_id").alias(k), F.col("n").alias(f"_n{k}"), F.col("map").alias(f"_m{k}"), F.col("half").alias(f"_h{k}")) for k in ("a", "b"))
    same = F.size("_ma") == F.size("_mb")
    mine, other = F.when(same | (F.size("_ma") < F.size("_mb")), F.col("_ma")).otherwise(F.col("_ha")), F.when(same | (F.size("_mb") < F.size("_ma")), F.col("_mb")).otherwise(F.col("_hb"))
    apart = F.aggregate(F.zip_with(mine, other, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, w: n + w)
    # Sets of sizes that can link have bitmaps of like size, or one twice the other's.
    near = F.greatest("_na", "_nb") * PERCENT <= 100 * F.least("_na", "_nb")
    both = pairs.join(y, "b").join(x, "a")
    done = shared.written(both.select("a", "b", (F.col("_na") + F.col("_nb")).alias("both"), F.when(near, apart).otherwise(F.col("_na") + F.col("_nb")).cast("long").alias("apart")), "bounded")
    shared.dropped(marks)
    return done


def _compared(pairs: DataFrame, docs: DataFrame, digests: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, least and most (bounds of the distance, equal where it was found exactly) and link, for each pair of set ids."""
    bounded = _bounded(pairs, digests, sets)
    # Sets that share 80 % of their union are apart by a ninth of both sizes at most.
    may = (100 - PERCENT) * F.col("both") >= (100 + PERCENT) * F.col("apart")
    wanted = bounded.where(may).select("a", "b")
    exact = _exact(wanted, docs, sets).select("a", "b", "shared")
    joined = bounded.join(exact, ["a", "b"], "left")
    far = 1 - F.col("shared") / (F.col("both") - F.col("shared"))
    least = 2 * F.col("apart") / (F.col("both") + F.col("apart"))
    return shared.written(joined.select("a", "b", F.coalesce(far, least).alias("least"), F.coalesce(far, F.lit(1.0)).alias("most"), F.coalesce(_is_link(F.col("shared"), F.col("both")), F.lit(False)).alias("link")), "compared")


def _exact(pairs: DataFrame, docs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b and shared of each pair of set ids, by intersecting the sets; ``sets`` has a row number for each."""
    ends = pairs.select(F.col("a").alias("set_id")).unionByName(pairs.select(F.col("b").alias("set_id"))).distinct()
    wanted = shared.written(ends.join(sets.select("set_id", "_rid"), "set_id"), "wanted")
    chosen = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    texts = docs.select("_rid", F.col("text").cast("string").alias("text")).join(chosen, "_rid").select("set_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in bpe.text_slices(batch.column("text")):
                found = shingle_sets(data, offsets)
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("set_id").slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).view(np.int64)))], ["set_id", "s"])

    whole = shared.written(shared.mapped(texts, run, "set_id long, s array<long>"), "sets")
    left, right = whole.select(F.col("set_id").alias("a"), F.col("s").alias("_sa")), whole.select(F.col("set_id").alias("b"), F.col("s").alias("_sb"))
    done = shared.written(pairs.join(right, "b").join(left, "a").select("a", "b", F.size(F.array_intersect("_sa", "_sb")).cast("long").alias("shared")), "exact")
    shared.dropped(whole, wanted)
    return done


def _is_link(shared_: Column, both: Column) -> Column:
    return 100 * shared_ >= PERCENT * (both - shared_)


def linked(docs: DataFrame) -> DataFrame:
    """_rid, doc_id, n_shingles, component_id and _comp (the component's own number; null for empty sets); ``docs`` has _rid, doc_id and text."""
    salt = 0
    while True:
        every = shared.written(_digests(docs, salt), "digests")
        digests = every.where("n >= 0").drop("often", "times")
        sets = shared.written(digests.where("n > 0").groupBy("set_id").agg(F.min("n").alias("n"), F.min("_rid").alias("_rid"), F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.min("check").alias("_c0"), F.max("check").alias("_c1")), "set_ids")
        if sets.where("_c0 <> _c1").isEmpty():
            break
        shared.dropped(every, sets)
        salt += 1
    often = every.where("n < 0").select(F.explode(F.arrays_zip("often", "times")).alias("o")).groupBy(F.col("o.often").alias("shingle")).agg(F.sum("o.times").alias("times"))
    often = shared.written(often, "often")
    top = often.where(F.col("times") >= TIMES).orderBy(F.desc("times"), "shingle").limit(MOST_FREQUENT).toArrow()
    frequent = np.sort(top.column("shingle").to_numpy().view(np.uint64)) if top.num_rows else np.zeros(0, np.uint64)
    # Shingles that repeat without counting as frequent; entries of lists are taken to repeat as often.
    repeated = often.where(F.col("times") < TIMES).agg(F.sum("times").alias("n")).first()["n"] or 0
    shared.dropped(often)
    counts = sets.groupBy(F.least("n", F.lit(MOST_BOUNDARY + 1)).alias("n")).agg(F.count("*").alias("sets"), F.sum("n").alias("shingles")).collect()
    small = {r["n"]: r["sets"] for r in counts if 4 <= r["n"] <= MOST_BOUNDARY}
    light = boundary(small, sum(r["sets"] for r in counts if r["n"] > MOST_BOUNDARY), repeated / max(1, sum(r["shingles"] for r in counts)))
    lists, behind = _lists(_postings(docs, salt, frequent, light))
    stars = shared.written(_stars(lists), "stars")
    shared.dropped(*behind)
    del lists, behind
    shared.released(docs.sparkSession)
    first = stars.where("a <> b").select("a", "b").distinct()
    compared = _compared(first, docs, digests, sets)
    links = compared.where("link").select("a", "b")
    comps = components.components(links)
    more = _rest(stars, compared, comps, digests, sets)
    if not more.isEmpty():
        again = _compared(more, docs, digests, sets)
        links = links.unionByName(again.where("link").select("a", "b"))
        comps = components.components(links)
    of_sets = sets.join(comps, sets["set_id"] == comps["v"], "left").select("set_id", "doc_id", "copies", F.coalesce("comp", "set_id").alias("comp"))
    least = of_sets.groupBy("comp").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("_sets"))
    known = of_sets.join(least, "comp").where("_sets > 1 or copies > 1").select("set_id", "comp", "component_id")
    classes = shared.written(known, "classes")
    return digests.join(classes, "set_id", "left").select(
        "_rid", "doc_id", F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.when(F.col("n") > 0, F.coalesce("comp", "set_id")).alias("_comp"),
    )


def _rest(stars: DataFrame, compared: DataFrame, comps: DataFrame, digests: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of one list that may link, aren't compared, and whose sets are in different components."""
    member = stars.where("open").select("key", "a", F.col("b").alias("s"), "n", "reach")
    placed = member.join(comps, member["s"] == comps["v"], "left").select("key", "a", "s", "n", "reach", F.coalesce("comp", "s").alias("comp"))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("_least"), F.max("comp").alias("_most"), F.count("*").alias("size")).where("_least <> _most").select("key", "size")
    held = shared.written(mixed, "mixed")
    left = shared.written(placed.join(held, "key"), "unclosed")
    few = _pairs_of_short_lists(left.where(F.col("size") <= SHORT_LIST), compared)
    many = _pairs_of_long_lists(left.where(F.col("size") > SHORT_LIST), digests, sets)
    pairs = few.unionByName(many).distinct()
    done = compared.select(F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q"))
    return shared.written(pairs.join(done, ["p", "q"], "left_anti").select(F.col("p").alias("a"), F.col("q").alias("b")), "rest")


def _pairs_of_short_lists(left: DataFrame, compared: DataFrame) -> DataFrame:
    """p and q of the pairs in lists of bounded length, less those that sizes, positions or distances to the centre rule out."""
    apart = compared.select("a", F.col("b").alias("s"), "least", "most")
    known = left.join(apart, ["a", "s"], "left").select("key", F.struct("a", "s", F.col("n").cast("long").alias("n"), F.col("reach").cast("long").alias("reach"), "comp", F.coalesce("least", F.lit(0.0)).alias("least"), F.coalesce("most", F.lit(0.0)).alias("most")).alias("m"))
    lists = known.groupBy("key").agg(F.collect_list("m").alias("m")).select("m")
    far = (100 - PERCENT) / 100 + 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("m")
            size, flat = column.value_lengths().to_numpy(), column.flatten()
            c = {f.name: flat.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(flat.type)}
            begin, p, q = np.cumsum(size) - size, [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for k in np.unique(size[size > 1]):
                i, j = np.triu_indices(k, 1)
                own = begin[size == k][:, None]
                i, j = (own + i).ravel(), (own + j).ravel()
                may = (c["s"][i] != c["s"][j]) & (c["comp"][i] != c["comp"][j]) & (c["n"][i] <= c["reach"][j]) & (c["n"][j] <= c["reach"][i])
                may &= (c["a"][i] != c["a"][j]) | ((c["least"][i] - c["most"][j] <= far) & (c["least"][j] - c["most"][i] <= far))
                p.append(np.minimum(c["s"][i[may]], c["s"][j[may]]))
                q.append(np.maximum(c["s"][i[may]], c["s"][j[may]]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (p, q)], ["p", "q"])

    return shared.mapped(lists, run, "p long, q long")


def _reached(members: DataFrame, others: DataFrame) -> DataFrame:
    """``members`` with a set among ``others`` of their list that is in a different component and that sizes and positions let link."""
    of = others.groupBy(F.col("key").alias("_key"), F.col("n").alias("_n")).agg(F.max("reach").alias("_reach"), F.min("comp").alias("_from"), F.max("comp").alias("_to"))
    fits = (F.col("n") <= F.col("_reach")) & (F.col("_n") <= F.col("reach")) & ((F.col("comp") != F.col("_from")) | (F.col("comp") != F.col("_to")))
    return members.join(of, (F.col("key") == F.col("_key")) & fits, "left_semi")


def _pairs_of_long_lists(left: DataFrame, digests: DataFrame, sets: DataFrame) -> DataFrame:
    """p and q of the pairs that bitmaps let link.

    First go the sets outside a list's largest component (strays) that nothing in the list can link with by sizes
    and positions, then all others that no remaining stray can link with: a copy changed so much that it is a
    stray mostly has its own shingles before those that it shares with the many.  What remains goes into blocks of
    sets of like size, and strays into blocks of their own; each pair of blocks that sizes let link is one row,
    compared in numpy.  The blocks of strays of a list are dealt over tasks, a few to each, which meet the list's
    blocks of the sizes in reach.  A pair is given only by the least of the keys where they let it link.
    """
    sized = left.groupBy("key", "comp").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("comp", "n").alias("main"))
    strays = shared.written(_reached(left.join(sized, "key").where("comp <> main").drop("main"), left), "strays")
    met = shared.written(_reached(left, strays), "met")
    # A stray whose like are all in the largest component is met by no stray.
    keys = met.unionByName(strays).select("key", "s", "comp", "reach").distinct().groupBy("s").agg(F.first("comp").alias("comp"), F.collect_list(F.struct("key", "reach")).alias("k")).select("s", "comp", F.col("k.key").alias("keys"), F.col("k.reach").alias("reaches"))
    marks = shared.written(
        keys.join(sets.select(F.col("set_id").alias("s"), "_rid"), "s").join(digests.select("_rid", "n", "map", "half"), "_rid").select("s", "comp", "n", "map", "half", "keys", "reaches"), "blocks")
    class_ = lambda n: F.floor(F.log(n.cast("double")) / math.log(SIZE_CLASS)).cast("int")

    def blocks(members: DataFrame, name: str, *more: Column) -> DataFrame:
        """key, class, block, the block's least size and longest reach, and its sets as ``name``."""
        placed = members.select("key", "s", "reach", class_(F.col("n")).alias("class"), F.col("n").alias("_n"))
        held = placed.groupBy("key", "class").agg(F.ceil(F.count("*") / F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_SHINGLES) / F.max("_n"))))).alias("_blocks"))
        dealt = placed.join(held, ["key", "class"]).withColumn("block", F.pmod(F.xxhash64("s"), "_blocks")).drop("_n")
        m = F.struct("s", "comp", "n", "map", "half", "keys", "reaches", "reach")
        return dealt.join(marks, "s").groupBy("key", "class", "block").agg(F.min("n").alias("_least"), F.max("n").alias("_most"), F.max("reach").alias("_reach"), F.collect_list(m).alias(name))

    y = blocks(strays, "y")
    # Each block of strays goes to the classes of sizes that its sets can link with.
    lowest = class_(F.ceil(F.col("_least") * PERCENT / 100))
    y = y.select("key", F.explode(F.sequence(lowest, F.greatest(lowest, class_(F.col("_reach"))))).alias("class"), F.col("block").alias("_block"), F.col("_least").alias("_y0"), F.col("_reach").alias("_y1"), "y")
    wanted = strays.groupBy("key").agg(F.ceil(F.count("*") / (BLOCK * STRAY_BLOCKS)).cast("int").alias("salts"))
    salt = F.pmod(F.xxhash64("_block", "_y0"), F.col("salts").cast("long")).cast("int").alias("salt")
    y = y.join(wanted, "key").select("key", "class", salt, "_y0", "_y1", "y")
    x = blocks(met, "x").join(wanted, "key").select("key", "class", F.col("_least").alias("_x0"), F.col("_reach").alias("_x1"), "x", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, x, y in zip(*(batch.column(c) for c in ("key", "x", "y"))):
                found = list(_block_pairs(key.as_py(), x.as_py(), y.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["p", "q"])

    both = x.join(y, ["key", "class", "salt"]).where("_x0 <= _y1 AND _y0 <= _x1")
    return shared.mapped(both.select("key", "x", "y"), run, "p long, q long")


def _block_pairs(key: int, x: list[dict], y: list[dict]) -> Iterator[tuple[int, int]]:
    by_words: dict[int, list[dict]] = {}
    for m in x:
        by_words.setdefault(len(m["map"]), []).append(m)
    tables = {w: (ms, *(np.array([m[c] for m in ms], np.int64) for c in ("n", "reach", "comp", "map", "half"))) for w, ms in by_words.items()}
    for m in y:
        own = dict(zip(m["keys"], m["reaches"]))
        for w, (ms, n, reach, comp, map_, half) in tables.items():
            if len(m["map"]) == w:
                mine, theirs = m["map"], map_
            elif len(m["half"]) == w and len(m["map"]) == 2 * w:
                mine, theirs = m["half"], map_
            elif 2 * len(m["map"]) == w:
                mine, theirs = m["map"], half
            else:
                continue  # of sizes that can't link
            near = np.flatnonzero((n <= m["reach"]) & (m["n"] <= reach) & (comp != m["comp"]))
            apart = np.bitwise_count((theirs[near] ^ np.array(mine, np.int64)).view(np.uint64)).sum(axis=1, dtype=np.int64)
            for i in near[(100 - PERCENT) * (n[near] + m["n"]) >= (100 + PERCENT) * apart].tolist():
                if min(k for k, r in zip(ms[i]["keys"], ms[i]["reaches"]) if m["n"] <= r and n[i] <= own.get(k, 0)) == key:
                    yield min(m["s"], ms[i]["s"]), max(m["s"], ms[i]["s"])


def _parts(numbered: DataFrame) -> DataFrame:
    return numbered.select("_rid", F.col("doc.doc_id").alias("doc_id"), F.col("doc.text").alias("text"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id, then the first."""
    numbered = shared.numbered(docs)
    groups = linked(_parts(numbered))
    first = groups.where("_comp is not null").groupBy("_comp").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_rid"))).alias("first"))
    kept = first.select("first._rid").unionByName(groups.where("_comp is null").select("_rid"))
    return numbered.join(kept, "_rid", "left_semi").select(*shared.fields(docs))


def digest(docs: DataFrame) -> DataFrame:
    return linked(_parts(shared.numbered(docs))).select("doc_id", "n_shingles", "component_id")


#: The same in DuckDB's SQL.
SQL = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[p : p + 4], ' ') END AS s
      FROM (SELECT *, unnest(generate_series(1, greatest(1, len(w) - 4))) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS v, doc_id AS u FROM documents UNION SELECT r.v, e.b FROM r JOIN e ON r.u = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id
FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN (SELECT v, min(u) AS component_id FROM r GROUP BY v) m ON m.v = d.doc_id
"""
