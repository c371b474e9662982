"""Byte-level BPE encoding and decoding, speculate-and-verify, over Arrow batches.

Encoding one batch of texts:

1. *Pre-tokenise* all texts at once: code points are classified through one lookup table and word
   boundaries come from vectorised comparisons (no regular expression is run over the texts).
2. *Dictionary-encode* the words, so that every later step sees each distinct word once.
3. *Speculate*: greedy longest match proposes tokens for each word that this worker hasn't met.
4. *Verify*: all adjacent token pairs of all new words are tested in one vectorised compatibility
   check.  A token sequence whose neighbours are all compatible is what BPE produces.
5. *Merge exactly* only the words with a failing pair (heap over a linked list, n log n).

Decoding gathers the bytes of each id and reads them as UTF-8 with replacement, as the byte-level
decoder of the ``tokenizers`` library does.

Defined cases: a null text counts as empty; an empty text has no ids; the special token's string in a
text is the special token (the library's default); repeated rows are encoded once each; other columns
pass through untouched.  The result has one row per input row, whatever ``doc_id`` holds.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm import shared

VOCABULARY = "byte_bpe_50k.json"
#: Words that a worker remembers before it starts afresh.
CACHE_WORDS = 800_000
#: Bytes of text handled at once; one longer text is still handled whole.
SLICE_BYTES = 1 << 20
#: Bytes up to which a word is merged in a plain list.
SHORT_WORD = 100
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3


def vocabulary_path(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _byte_chars() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies, inverted."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


_classes: np.ndarray | None = None


def char_classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    global _classes
    if _classes is None:
        import regex

        points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
        text, at = "".join(map(chr, points)), np.array(points)
        table = np.zeros(0x110000, np.uint8)
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
            for m in regex.finditer(pattern, text):
                table[at[m.start() : m.end()]] = kind
        _classes = table
    return _classes


class Vocabulary:
    """Tables of one vocabulary file.  Ids rise with merge rank, which the constructor checks."""

    def __init__(self, path: str | None = None):
        with open(vocabulary_path(path), encoding="utf-8") as f:
            spec = json.load(f)
        chars, vocab = _byte_chars(), spec["model"]["vocab"]
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes = [b""] * self.size
        for word, i in vocab.items():
            self.bytes[i] = bytes(map(chars.__getitem__, word))
        self.ids = {b: i for i, b in enumerate(self.bytes) if b}
        for word, i in self.special.items():
            self.bytes[i] = word
        self.left, self.right = np.full(self.size, -1, np.int64), np.full(self.size, -1, np.int64)
        keys, made, last = [], [], -1
        for merge in spec["model"]["merges"]:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            i, left, right = vocab[a + b], vocab[a], vocab[b]
            if i <= last:
                raise ValueError("ids of merges must rise with their rank")
            last = i
            self.left[i], self.right[i] = left, right
            keys.append(left * self.size + right)
            made.append(i)
        self.merges = dict(zip(keys, made))
        self.singles = [self.ids.get(bytes([b]), -1) for b in range(256)]
        order = np.argsort(keys)
        self.keys, self.made = np.array(keys, np.int64)[order], np.array(made, np.int64)[order]
        self.longest: dict[bytes, int] = {}
        for b in self.ids:
            self.longest[b[:2]] = max(self.longest.get(b[:2], 0), len(b))
        self.texts = pa.array(self.bytes, pa.binary())
        self.decimals = pa.array([b"%d," % i for i in range(self.size)], pa.binary())

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token each pair merges to, or a number above all ids."""
        at = np.minimum(np.searchsorted(self.keys, key := a * self.size + b), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], self.size)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE leaves each pair of neighbours as it is.

        The merges that made both tokens are undone, latest first; at each point of that history a
        merge across the border that would have come before the step just undone refutes the pair.
        Equal ranks apply from the left, hence a left token wins a tie and a right one loses it.
        """
        a, b = a.astype(np.int64), b.astype(np.int64)
        good, open_ = np.ones(len(a), bool), np.arange(len(a))
        until = np.full(len(a), self.size)
        while len(open_):
            clash = self.merged(a, b) < until
            good[open_[clash]] = False
            whole_a, whole_b = self.left[a] < 0, self.left[b] < 0
            undo_a = ~whole_a & (whole_b | (a > b))
            until = np.where(undo_a, a, b + 1)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a | whole_b, b, self.left[b])
            on = ~clash & ~(whole_a & whole_b)
            a, b, until, open_ = a[on], b[on], until[on], open_[on]
        return good

    def greedy(self, word: bytes) -> list[int]:
        ids, longest, out, at, n = self.ids, self.longest, [], 0, len(word)
        while at < n:
            k = min(longest.get(word[at : at + 2], 1), n - at)
            while (i := ids.get(word[at : at + k])) is None:
                k -= 1
            out.append(i)
            at += k
        return out

    def exact(self, word: bytes) -> list[int]:
        """BPE by its definition: the lowest rank first, from the left."""
        ids = [self.singles[b] for b in word]
        if len(ids) <= SHORT_WORD:
            return self._exact_short(ids)
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        get, size = self.merges.get, self.size
        heap = [(m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := get(ids[i] * size + ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            m, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = m, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (x := get(m * size + ids[k])) is not None:
                    heapq.heappush(heap, (x, i, m, ids[k]))
            if (h := before[i]) >= 0 and (x := get(ids[h] * size + m)) is not None:
                heapq.heappush(heap, (x, h, ids[h], m))
        return [i for i in ids if i >= 0]

    def _exact_short(self, ids: list[int]) -> list[int]:
        get, size = self.merges.get, self.size
        ranks = [get(a * size + b, size) for a, b in zip(ids, ids[1:])]
        while ranks and (m := min(ranks)) < size:
            i = ranks.index(m)
            ids[i : i + 2] = [m]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get(m * size + ids[i + 1], size)
            if i:
                ranks[i - 1] = get(ids[i - 1] * size + m, size)
        return ids


def split_words(data: bytes, offsets: np.ndarray, special: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which words start (with the end appended), and words before each text.

    ``data`` holds the texts one after another, ``offsets`` their bounds.  The words are those of the
    byte-level pre-tokeniser; each special string is a word of its own.
    """
    ends = offsets.astype(np.int64)
    if not data:
        return np.zeros(1, np.int64), np.zeros(len(ends), np.int64)
    points = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
    n = len(points)
    if n == len(data):
        at = np.arange(n + 1)
    else:
        at = np.append(np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80), len(data))
    bounds = np.searchsorted(at, ends) if n != len(data) else ends
    kind = char_classes()[points]
    first = np.zeros(n + 1, bool)
    first[bounds] = True
    first[0] = first[n] = True
    fixed = []
    for word in special:
        p = data.find(word)
        while p >= 0:
            a, b = np.searchsorted(at, (p, p + len(word)))
            if not first[a + 1 : b].any():
                first[a] = first[b] = True
                fixed.append((a, b))
                p = data.find(word, p + len(word))
            else:
                p = data.find(word, p + 1)
    start = first.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    last = np.flatnonzero(space[:-1] & ~space[1:] & ~first[1:n])  # white space just before a word
    start[last] = True
    start[last[points[last] == 32] + 1] = False
    quote = np.flatnonzero(points == 39)
    if len(quote):
        padded = np.append(points, np.zeros(3, np.uint32))
        inside = np.append(first, np.ones(3, bool))
        prior = np.maximum(quote - 1, 0)
        fresh = first[quote] | (kind[prior] == LETTER) | (kind[prior] == NUMBER) | (space[prior] & (points[prior] != 32))
        one, two = padded[quote + 1], padded[quote + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long_ = ((two == ord("e")) & ((one == ord("r")) | (one == ord("v")))) | ((one == ord("l")) & (two == ord("l")))
        long_ &= ~inside[quote + 2]
        fits = fresh & (short | long_) & ~inside[quote + 1]
        quote, size = quote[fits], np.where(long_[fits], 3, 2)
        start[quote] = True
        start[quote + 1] = False
        start[quote[size == 3] + 2] = False
        start[quote + size] = True
    for a, b in fixed:
        start[a + 1 : b] = False
        start[a] = start[b] = True
    begins = np.flatnonzero(start[:n])
    return np.append(at[begins], len(data)), np.searchsorted(begins, bounds)


def gather(values: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """values[begin[i] : begin[i] + size[i]] of all i, one after another."""
    ends = np.cumsum(size)
    if not len(ends) or not ends[-1]:
        return values[:0]
    return values[np.arange(ends[-1]) + np.repeat(begin - ends + size, size)]


class Encoder:
    """Ids of batches of texts; remembers the words it has met."""

    def __init__(self, path: str | None = None):
        self.vocabulary = Vocabulary(path)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.begin, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.pool, self.used = np.zeros(1 << 18, np.int32), 0
        self.exactly = 0

    def _learn(self, words: list[bytes]) -> None:
        v = self.vocabulary
        special = {i: [v.special[w]] for i, w in enumerate(words) if w in v.special}
        found = [v.greedy(w) for w in words]
        size = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for ids in found for i in ids), np.int64, int(size.sum()))
        owner = np.repeat(np.arange(len(found)), size)
        pair = np.flatnonzero(owner[1:] == owner[:-1])
        both, back = np.unique(flat[pair] * v.size + flat[pair + 1], return_inverse=True)
        bad = ~v.compatible(both // v.size, both % v.size)[back] if len(both) else np.zeros(0, bool)
        for i in np.unique(owner[pair[bad]]):
            found[i] = v.exact(words[i])
            self.exactly += 1
        for i, ids in special.items():
            found[i] = ids
        self._store(words, found)

    def _store(self, words: list[bytes], found: list[list[int]]) -> None:
        size = np.fromiter(map(len, found), np.int64, len(found))
        self._keep(words, np.fromiter((i for ids in found for i in ids), np.int32, int(size.sum())), size)

    def _keep(self, words: list[bytes], flat: np.ndarray, size: np.ndarray) -> None:
        """The words' ids, one word after another, and how many each has."""
        n, m = len(self.known), self.used
        if n + len(words) > len(self.begin):
            more = max(len(self.begin), n + len(words))
            self.begin, self.size = (np.concatenate([x, np.zeros(more, np.int64)]) for x in (self.begin, self.size))
        if m + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), m + len(flat)), np.int32)])
        self.begin[n : n + len(words)] = m + np.cumsum(size) - size
        self.size[n : n + len(words)] = size
        self.pool[m : m + len(flat)] = flat
        self.used = m + len(flat)
        self.known.update(zip(words, range(n, n + len(words))))

    def encode(self, data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and the bounds of each text in them."""
        begins, before = split_words(data, offsets, list(self.vocabulary.special))
        if len(begins) < 2:
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        words = pa.BinaryArray.from_buffers(pa.binary(), len(begins) - 1, [None, pa.py_buffer(begins.astype(np.int32)), pa.py_buffer(data)])
        coded = words.dictionary_encode()
        code, distinct = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False)
        if len(self.known) > CACHE_WORDS:
            self._forget()
        at = np.fromiter(map(self.known.get, distinct, itertools.repeat(-1)), np.int64, len(distinct))
        if len(new := distinct[at < 0]):
            self._learn(new.tolist())
            at[at < 0] = np.fromiter(map(self.known.__getitem__, new), np.int64, len(new))
        at = at[code]
        size = self.size[at]
        ends = np.concatenate([[0], np.cumsum(size)])
        return gather(self.pool, self.begin[at], size), ends[before]


_encoders: dict[str | None, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """This process's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def text_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """(first row, row after the last, bytes of the texts, their bounds) in pieces of bounded size."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = memoryview(column.buffers()[2] or b"")
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + most, "right")) - 1)
        yield a, b, bytes(data[bounds[a] : bounds[b]]), bounds[a : b + 1] - bounds[a]
        a = b


def decode(vocabulary: Vocabulary, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """The text of each run of ids, in UTF-8."""
    joined = vocabulary.texts.take(pa.array(ids))
    at = np.frombuffer(joined.buffers()[1], np.int32)[bounds] if len(ids) else np.zeros(len(bounds), np.int32)
    data = memoryview(joined.buffers()[2] or b"") if len(ids) else memoryview(b"")
    out = []
    for a, b in zip(at[:-1], at[1:]):
        piece = bytes(data[a:b])
        try:
            piece.decode()
        except UnicodeDecodeError:
            piece = piece.decode("utf-8", "replace").encode()
        out.append(piece)
    return out


def _hashes(joined: pa.Array, bounds: np.ndarray, drop: int) -> list[str]:
    at = np.frombuffer(joined.buffers()[1], np.int32)[bounds].tolist() if len(joined) else [0] * len(bounds)
    data = memoryview(joined.buffers()[2] or b"") if len(joined) else memoryview(b"")
    return [hashlib.sha256(data[a : max(a, b - drop)]).hexdigest() for a, b in zip(at[:-1], at[1:])]


def encode_texts(docs: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None) -> DataFrame:
    """``docs`` with its rows' token ids in an array column ``ids``."""
    names = [c for c in docs.columns if c != ids]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names) + f", `{ids}` array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for a, b, data, bounds in text_slices(batch.column(text)):
                flat, at = enc.encode(data, bounds)
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in names), lists], [*names, ids])

    return shared.mapped(docs.select(*names), run, schema)


def decode_ids(rows: DataFrame, ids: str = "ids", text: str = "text", path: str | None = None) -> DataFrame:
    """``rows`` with the text of the ids in an array column; a null array gives null."""
    names = [c for c in rows.columns if c != text]
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names) + f", `{text}` string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = encoder(path).vocabulary
        for batch in batches:
            column = batch.column(ids)
            values, at = column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
            found = [x.decode() if ok else None for x, ok in zip(decode(v, values.astype(np.int64), at), column.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(found, pa.string())], [*names, text])

    return shared.mapped(rows.select(*names), run, schema)


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, and hashes of the ids and of the text decoded from them, for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        v = enc.vocabulary
        for batch in batches:
            for a, b, data, bounds in text_slices(batch.column("text")):
                ids, at = enc.encode(data, bounds)
                listed = _hashes(v.decimals.take(pa.array(ids)), at, 1)
                texts = [hashlib.sha256(x).hexdigest() for x in decode(v, ids, at)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(np.diff(at)), pa.array(listed), pa.array(texts)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return shared.mapped(docs.select("doc_id", F.col("text").cast("string")), run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), path: str | None = None) -> DataFrame:
    """The kept columns, ids, n_tokens, and round_trip: whether decoding the ids gives the text."""
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", ids array<int>, n_tokens long, round_trip boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for a, b, data, bounds in text_slices(batch.column("text")):
                ids, at = enc.encode(data, bounds)
                same = [x == data[i:j] for x, i, j in zip(decode(enc.vocabulary, ids, at), bounds[:-1].tolist(), bounds[1:].tolist())]
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in keep), lists, pa.array(np.diff(at)), pa.array(same, pa.bool_())], [*keep, "ids", "n_tokens", "round_trip"])

    return shared.mapped(docs.select(*keep, F.col("text").cast("string").alias("text")), run, schema)
