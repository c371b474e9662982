"""Token-id files: adaptive context-mixing range coding in independent, checksummed blocks.

A file holds *frames* of whole documents.  A frame's frequent pairs of ids become symbols, then frequent pairs
of symbols, three times over, so that fewer are left to code; these are cut into *blocks*, each coded from a fresh
model and with the CRC-32 of its ids at the frame's head (which has one of its own), so that any block can be read
or refused alone.  The head lists the ids, the pairs and the *alphabet*, the symbols in use by falling frequency;
what is coded are their ranks.

The model of a block mixes three predictions of the next rank: order 2 and order 1 each name the one that
followed their context (a hash of the last two, or the last one) with a confidence of 0 to 3; order
0 is an adaptive distribution over 64 classes of ranks, 16 single ones and then four to each doubling, even
within a class, where frequencies differ by a quarter or so.  The mixture is
``w2 [id = c2] + w1 [id = c1] + w0 p0(id)``; the weights are learnt as coding goes, one set for each
pair of confidences and for agreeing or differing predictions.  A 64-bit range coder with carries
codes the mixture.

All blocks of a frame are coded side by side, one numpy lane each, so a step of the Python loop codes
a symbol in every block.  Memory is bounded by a frame, ``FRAME_IDS`` ids or one longer document.

Defined cases: null and empty texts have the end id alone; documents come in ascending ``doc_id``
(nulls first, ties by a hash of the text); repeated rows are kept; an empty table gives an empty file.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.llm import bpe, shared

FRAME_IDS = 4 << 20
LANES, LEAST_BLOCK, MOST_BLOCK = 2048, 512, 8192
#: Ranks that are a class each; classes to each doubling of the rank after these; distinct ids of a frame at most.
SINGLES, CLASSES, MOST_DISTINCT = 16, 4, 16 << 12
#: Rounds in which pairs become symbols; pairs of a round at most; times that a pair is met at least, every _SAMPLED-th looked at.
ROUNDS, MOST_PAIRS, LEAST_TIMES, _SAMPLED = 3, 16384, 4, 4
#: Symbols handled at once.
_PIECE = 1 << 16
MAGIC = b"LSTOK3\0\0"
_EVERY = 32
_U = np.uint64
#: A range as small as this gets another word of 16 bits.
_SHORT = 1 << 47
#: Factors of the contexts' hashes.
_K1, _K2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: A weight moves by a sixteenth: p - p // 16 + 3875 if its order is right, + 2 if not; that of order 1 stays if order 2 is right.
_HIT2, _HIT1, _MISS = 3875 << 32, (2 << 32) + 3875 - (3875 << 32) + (1 << 64), 2 - 3875 + (1 << 64)
_LOW, _LOW_STEP, _HIGH_STEP = 0xFFFFFFFF, 0xFFF, 0xFFF << 32
_CONSTANTS = (4, 16, 32, 65536, _SHORT, _K1, _K2, _HIT2, _HIT1, _MISS, _LOW, _LOW_STEP, _HIGH_STEP)
#: 64 classes in quarters, these in quarters, and so on: the first bound of each split and the distance of the next two.
_SPLITS = np.array([16, *range(4, 64, 16), *range(1, 64, 4)])
_STRIDES = np.array([16] + [4] * 4 + [1] * 16)
_TOPS = 0x800080008000
_ORDINALS = np.arange(1, 65)[:, None]


def _class_tables() -> tuple[np.ndarray, np.ndarray]:
    """The first rank of each class and the bits of a rank within it."""
    bits = np.concatenate([np.zeros(SINGLES, np.int64), np.repeat(np.arange(2, 14), CLASSES)])
    size = 1 << bits
    return np.cumsum(size) - size, bits


_FIRST, _BITS = _class_tables()


def _kind(ranks: np.ndarray) -> np.ndarray:
    """The class of each rank."""
    return np.searchsorted(_FIRST, ranks, "right") - 1


def _merged(symbols: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """``symbols`` with frequent pairs as symbols numbered from ``first``, and these pairs (left << 16 | right), rising."""
    most = min(MOST_PAIRS, MOST_DISTINCT - first)
    if most <= 0 or len(symbols) < 2:
        return symbols, np.zeros(0, np.uint32)
    left, right = (symbols[i : len(symbols) - 1 + i : _SAMPLED].astype(np.uint32) for i in (0, 1))
    each, times = np.unique((left << np.uint32(16)) | right, return_counts=True)
    each, times = each[times >= LEAST_TIMES], times[times >= LEAST_TIMES]
    each = each[np.argsort(-times, kind="stable")[:most]]
    slot = lambda x: (x * np.uint32(2654435761)) >> np.uint32(15)
    held, number = np.zeros(1 << 17, np.uint32), np.zeros(1 << 17, np.int32)
    held[0] = 1  # each empty slot holds a pair that belongs elsewhere
    held[slot(each[::-1])] = each[::-1]  # where two meet, the more frequent one stays
    each = np.sort(each[held[slot(each)] == each])
    number[slot(each)] = first + np.arange(len(each))
    out = []
    for i in range(0, len(symbols), _PIECE):  # small enough for a core's cache; no pair across
        piece = symbols[i : i + _PIECE].copy()
        pairs = (piece[:-1].view(np.uint32) << np.uint32(16)) | piece[1:].view(np.uint32)
        slots = slot(pairs)
        found = held[slots] == pairs
        place = np.arange(len(pairs), dtype=np.int32)
        other = np.maximum.accumulate(np.where(found, np.int32(-1), place))
        at = np.flatnonzero(found & ((place - other) & 1).astype(bool))  # every other one of those that overlap
        piece[at] = number[slots[at]]
        piece[at + 1] = -1
        out.append(piece[piece >= 0])
    return np.concatenate(out), each


def _phrases(ids: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The symbols that spell ``ids``; the distinct ids, and the pairs of each round."""
    each = np.flatnonzero(np.bincount(ids))
    if len(each) > MOST_DISTINCT:
        raise ValueError(f"a frame holds at most {MOST_DISTINCT} distinct ids")
    dense = np.zeros(int(each[-1]) + 1, np.int32)
    dense[each] = np.arange(len(each))
    symbols, tables, n = dense[ids], [each], len(each)
    for _ in range(ROUNDS):
        symbols, pairs = _merged(symbols, n)
        tables.append(pairs)
        n += len(pairs)
    return symbols, tables


def _spelt(tables: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of all symbols one after another, and where those of each begin and how many they are."""
    pool = tables[0].astype(np.uint32)
    begin, size = np.arange(len(pool)), np.ones(len(pool), np.int64)
    for pairs in tables[1:]:
        halves = np.stack([pairs >> 16, pairs & 0xFFFF], axis=1).astype(np.int64)
        more, sizes = bpe.gather(pool, begin[halves].ravel(), size[halves].ravel()), size[halves].sum(axis=1)
        begin = np.concatenate([begin, len(pool) + np.cumsum(sizes) - sizes])
        pool, size = np.concatenate([pool, more]), np.concatenate([size, sizes])
    return pool, begin, size


def _ranked(symbols: np.ndarray, n: int) -> np.ndarray:
    """Those of the n symbols that occur, by falling frequency, in a class by number."""
    times = np.bincount(symbols, minlength=n)
    each = np.argsort(-times, kind="stable")[: int((times > 0).sum())]
    return each[np.lexsort((each, _kind(np.arange(len(each)))))]


def _packed_tables(tables: list[np.ndarray], alphabet: np.ndarray) -> bytes:
    """Differences, which are small within a table or class, byte plane by byte plane."""
    parts = [np.array([len(tables), *map(len, tables), len(alphabet)], "<u4").tobytes()]
    for table in [tables[0], *(x for pairs in tables[1:] for x in (pairs >> 16, pairs & 0xFFFF)), alphabet]:
        steps = np.diff(table.astype(np.int64), prepend=0).astype("<i4")
        parts.append(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T).tobytes())
    return zlib.compress(b"".join(parts), 6)


def _unpacked_tables(data: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    data = zlib.decompress(data)
    rounds = int(np.frombuffer(data, "<u4", 1)[0])
    sizes, at, found = np.frombuffer(data, "<u4", rounds + 1, 4).tolist(), 8 + 4 * rounds, []
    for n in [sizes[0], *(n for n in sizes[1:-1] for _ in range(2)), sizes[-1]]:
        planes = np.frombuffer(data, np.uint8, 4 * n, at).reshape(4, n)
        found.append(np.cumsum(np.ascontiguousarray(planes.T).view("<i4").ravel().astype(np.int64)))
        at += 4 * n
    pairs = [left << 16 | right for left, right in zip(found[1:-1:2], found[2:-1:2])]
    return [found[0], *pairs], found[-1]


class _Model:
    """What the blocks of a frame have learnt, a lane for each.

    An entry of ``table`` is the id that followed a context and, in its lowest two bits, the confidence; the
    lanes' entries of order 1 come first.  An entry of ``mix`` holds the weights of order 2 (upper half) and of
    order 1, of 65536.  Arrays that a step works on are kept from step to step, constants too: for some
    thousand lanes, numpy takes longer to make them than to use them.
    """

    def __init__(self, lanes: int, block: int):
        self.lanes = lanes
        self.slot_bits = max(8, block.bit_length() - 1)  # of order 2: about a slot for each id; order 1 has half as many
        self.table = np.zeros(lanes * 3 << self.slot_bits - 1, np.int32)
        self.mix = np.full(lanes * 32, 4000 << 32 | 4000, _U)
        self.counts, self.met = np.ones((64, lanes), np.int64), []
        self.last, self.before = np.zeros(lanes, _U), np.zeros(lanes, _U)
        self.narrow(lanes)

    def narrow(self, n: int) -> None:
        """Only the first n blocks go on."""
        self.n, lane = n, np.arange(n)
        self.last, self.before = self.last[:n].copy(), self.before[:n].copy()
        self.lane_mix = lane * 32
        bits = self.slot_bits
        self.base = np.concatenate([lane << bits - 1, (self.lanes << bits - 1) + (lane << bits)]).astype(_U)
        self.at = np.zeros(2 * n, _U)
        self.at_index = self.at.view(np.int64)
        self.entry, self.named, self.trust, self.work = (np.zeros(2 * n, np.int32) for _ in range(4))
        self.hashed, self.u, self.v, self.f1, self.f2 = (np.zeros(n, _U) for _ in range(5))
        self.not2, self.miss = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.weights, self.group, self.differ = np.zeros(n, _U), np.zeros(n, np.int64), np.zeros(n, bool)
        self.i = {c: np.full(2 * n, c, np.int32) for c in (0, 1, 2, 3)}
        self.c = {c: np.full(n, c, _U) for c in (64 - bits, 65 - bits, *_CONSTANTS)}
        self.one8 = np.ones(n, np.int8)
        self.rebuild()

    def rebuild(self) -> None:
        """Frequencies of the classes, of 4096 in all: (begin, width) of each, and what ``classes`` compares with."""
        if self.met:
            self.counts += 24 * np.bincount(np.concatenate(self.met), minlength=self.counts.size).reshape(self.counts.shape)
            self.met = []
        cum = self.cum = np.zeros((65, self.n), np.int64)
        for k in range(64):
            np.add(cum[k], self.counts[k, : self.n], out=cum[k + 1])
        cum[1:] *= ((4096 - 64) << 20) // cum[64]
        cum[1:] >>= 20
        cum[1:] += _ORDINALS
        cum[64] = 4096
        self.spans = ((cum[:-1] << 13) + cum[1:] - cum[:-1]).ravel()
        self.bounds = None

    def classes(self, values: np.ndarray, lanes: np.ndarray) -> np.ndarray:
        """The class in which each value of 4096 lies, by three bounds at a time in fields of 16 bits."""
        if self.bounds is None:
            self.bounds = (self.cum[_SPLITS] | self.cum[_SPLITS + _STRIDES] << 16 | self.cum[_SPLITS + 2 * _STRIDES] << 32).ravel()
        fields = values * 0x100010001 + _TOPS
        k = np.bitwise_count((fields - self.bounds[lanes]) & _TOPS).astype(np.int64)
        for first in (1, 5):
            k = 4 * k + np.bitwise_count((fields - self.bounds[(first + k) * self.n + lanes]) & _TOPS)
        return k

    def predict(self) -> None:
        """``named``: the ids of order 1, then of order 2; ``f1`` and ``f2``: what they get of 65536."""
        n, c, u, v = self.n, self.c, self.u, self.v
        np.multiply(self.last, c[_K1], out=self.hashed)
        np.right_shift(self.hashed, c[65 - self.slot_bits], out=self.at[:n])
        np.multiply(self.before, c[_K2], out=u)
        np.add(u, self.hashed, out=u)
        np.right_shift(u, c[64 - self.slot_bits], out=self.at[n:])
        np.add(self.at, self.base, out=self.at)
        self.before, self.hashed = self.hashed, self.before
        self.table.take(self.at_index, out=self.entry, mode="clip")
        np.right_shift(self.entry, self.i[2], out=self.named)
        np.bitwise_and(self.entry, self.i[3], out=self.trust)
        np.not_equal(self.named[:n], self.named[n:], out=self.differ)
        k = self.work[:n]
        np.left_shift(self.trust[n:], self.i[2][:n], out=k)
        np.add(k, self.trust[:n], out=k)
        np.add(self.lane_mix, k, out=self.group)
        np.multiply(self.differ, 16, out=k)
        np.add(self.group, k, out=self.group)
        self.mix.take(self.group, out=self.weights, mode="clip")
        np.right_shift(self.weights, c[32], out=self.f2)
        np.bitwise_and(self.weights, c[_LOW], out=u)
        np.subtract(c[65536], self.f2, out=v)
        np.multiply(u, v, out=u)
        np.right_shift(u, c[16], out=self.f1)
        np.multiply(self.f1, self.differ, out=self.f1)

    def shares(self, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How much of each range order 2 and order 1 get."""
        np.right_shift(size, self.c[16], out=self.u)
        return self.u * self.f2, self.u * self.f1

    def shrink(self, size: np.ndarray, x2: np.ndarray, x1: np.ndarray) -> np.ndarray:
        """Cut each range to the part that ``not2`` and ``miss`` tell; the beginnings of the parts."""
        not2, miss = self.not2.view(_U), self.miss.view(_U)
        np.bitwise_and(x1, not2, out=self.u)
        np.add(x2, self.u, out=self.u)
        np.subtract(size, x2, out=size)
        np.subtract(size, x1, out=size)
        np.bitwise_and(size, miss, out=size)
        np.add(size, self.u, out=size)
        np.bitwise_and(x2, not2, out=x2)
        np.bitwise_and(x1, miss, out=x1)
        np.add(x1, x2, out=x1)
        np.subtract(size, x1, out=size)
        return x1

    def learn(self, ids: np.ndarray, hits: np.ndarray) -> None:
        """``hits``: whether order 1 (first row) and order 2 name the ids."""
        n, c, u, v, w = self.n, self.c, self.u, self.v, self.weights
        not2, miss = self.not2.view(_U), self.miss.view(_U)
        np.bitwise_and(not2, c[_LOW_STEP], out=v)
        np.bitwise_or(v, c[_HIGH_STEP], out=v)
        np.right_shift(w, c[4], out=u)
        np.bitwise_and(u, v, out=u)
        np.subtract(w, u, out=w)
        np.add(w, c[_HIT2], out=w)
        np.bitwise_and(not2, c[_HIT1], out=u)
        np.add(w, u, out=w)
        np.bitwise_and(miss, c[_MISS], out=u)
        np.add(w, u, out=w)
        self.mix[self.group] = w
        e, up = self.entry, self.work
        np.bitwise_or(e, self.i[3], out=up)
        np.add(e, self.i[1], out=self.named)
        np.minimum(up, self.named, out=up)
        np.subtract(e, self.i[1], out=e)
        fresh = self.named[:n]
        np.left_shift(ids, self.i[2][:n], out=fresh)
        down = np.where((self.trust == self.i[0]).reshape(2, n), fresh, e.reshape(2, n))
        self.table[self.at_index] = np.where(hits, up.reshape(2, n), down).ravel()
        self.last[:] = ids


def pack(ids: np.ndarray) -> bytes:
    """A frame of ids."""
    ids = np.ascontiguousarray(ids, np.uint32)
    n = len(ids)
    if not n:
        return _framed([0] * 4, b"", b"")
    symbols, tables = _phrases(ids)
    alphabet = _ranked(symbols, sum(map(len, tables)))
    rank = np.zeros(int(alphabet.max()) + 1, np.int32)
    rank[alphabet] = np.arange(len(alphabet))
    lanes = -(-n // min(MOST_BLOCK, max(LEAST_BLOCK, -(-n // LANES))))
    block = -(-len(symbols) // lanes)
    lanes = -(-len(symbols) // block)
    ends = np.cumsum(_spelt(tables)[2][symbols])[np.minimum(np.arange(1, lanes + 1) * block, len(symbols)) - 1].tolist()
    crc = np.array([zlib.crc32(ids[a:b]) for a, b in zip([0, *ends], ends)], "<u4")
    named = _packed_tables(tables, alphabet)
    padded = np.zeros(lanes * block, np.int32)
    padded[: len(symbols)] = rank[symbols]
    rows = np.ascontiguousarray(padded.reshape(lanes, block).T)  # a column for each block
    model = _Model(lanes, block)
    # The top bit of a word on its way out is a carry into the word before, 47 bits of low stay.
    low, size = np.zeros(lanes, _U), np.full(lanes, 2**63 - 1, _U)
    room = block * 3 + 8
    out, at = np.zeros(room * lanes, np.uint32), np.arange(lanes) * room
    tail = len(symbols) - (lanes - 1) * block
    kind_of = _kind(np.arange(len(alphabet)))
    for t in range(block):
        if t == tail:
            if lanes == 1:
                break
            model.narrow(lanes - 1)
        if t % _EVERY == 0:
            model.rebuild()
        m = model.n
        now, now_low, now_size = rows[t, :m], low[:m], size[:m]
        model.predict()
        hits = model.named.reshape(2, m) == now
        hit = hits[0] | hits[1]
        np.subtract(hits[1].view(np.int8), model.one8, out=model.not2)
        np.subtract(hit.view(np.int8), model.one8, out=model.miss)
        np.add(now_low, model.shrink(now_size, *model.shares(now_size)), out=now_low)
        rest = np.flatnonzero(~hit)
        if len(rest):
            value = now[rest]
            k = kind_of[value]
            span = model.spans[k * m + rest]
            step = size[rest] >> _U(12)
            fine = (step * (span & 8191).view(_U)) >> _BITS[k].view(_U)
            low[rest] += step * (span >> 13).view(_U) + fine * (value - _FIRST[k]).view(_U)
            size[rest] = fine
            model.met.append(k * lanes + rest)
        short = np.flatnonzero(now_size <= model.c[_SHORT])
        while len(short):
            was, to = low[short], at[short]
            out[to] = was >> _U(47)
            at[short] = to + 1
            low[short] = (was & _U(_SHORT - 1)) << _U(16)
            size[short] = wide = size[short] << _U(16)
            short = short[wide <= _U(_SHORT)]
        model.learn(now, hits)
    low += size >> _U(1)  # whatever comes after two words, the block's last id stays
    for _ in range(2):
        out[at] = low >> _U(47)
        low = (low & _U(_SHORT - 1)) << _U(16)
        at += 1
    at -= np.arange(lanes) * room
    out = np.ascontiguousarray(out.reshape(lanes, room)[:, : int(at.max())].T)
    for k in range(len(out) - 1, 0, -1):  # carries
        out[k - 1] += out[k] >> 16
    words = out.T[np.arange(len(out)) < at[:, None]].astype("<u2")
    return _framed([n, len(symbols), block, lanes], named, at.astype("<u4").tobytes() + crc.tobytes()) + words.tobytes()


def _framed(sizes: list[int], named: bytes, blocks: bytes) -> bytes:
    """All of a frame that comes before its blocks, with a checksum of its own."""
    fields = np.array([*sizes, len(named)], "<u4").tobytes()
    return MAGIC + fields + np.array([zlib.crc32(fields + named + blocks)], "<u4").tobytes() + named + blocks


def unpack(data: bytes) -> np.ndarray:
    """The ids of a frame; a damaged block is an error."""
    if data[:8] != MAGIC or len(data) < 32:
        raise ValueError("not a frame of token ids")
    n, n_symbols, block, lanes, held, check = np.frombuffer(data, "<u4", 6, 8).tolist()
    begin = 32 + held
    if len(data) < begin + 8 * lanes or zlib.crc32(data[8:28] + data[32 : begin + 8 * lanes]) != check:
        raise ValueError("the frame's head is damaged")
    if not n:
        return np.zeros(0, np.uint32)
    tables, alphabet = _unpacked_tables(data[32:begin])
    sizes = np.frombuffer(data, "<u4", lanes, begin).astype(np.int64)
    crc = np.frombuffer(data, "<u4", lanes, begin + 4 * lanes)
    if len(data) != begin + 8 * lanes + 2 * int(sizes.sum()):
        raise ValueError("the frame is cut short")
    words = np.append(np.frombuffer(data, "<u2", -1, begin + 8 * lanes).astype(_U), np.zeros(4, _U))
    at = np.cumsum(sizes) - sizes
    code, size = words[at] << _U(47) | words[at + 1] << _U(31) | words[at + 2] << _U(15) | words[at + 3] >> _U(1), np.full(lanes, 2**63 - 1, _U)
    words = (words[:-1] & _U(1)) << _U(15) | words[1:] >> _U(1)  # after 63 bits, words begin with the last bit of one
    at += 3
    rows, model, tail = np.zeros((block, lanes), np.int32), _Model(lanes, block), n_symbols - (lanes - 1) * block
    for t in range(block):
        if t == tail:
            if lanes == 1:
                break
            model.narrow(lanes - 1)
        if t % _EVERY == 0:
            model.rebuild()
        m = model.n
        now_code, now_size = code[:m], size[:m]
        model.predict()
        x2, x1 = model.shares(now_size)
        hit2, hit = now_code < x2, now_code < x2 + x1
        np.subtract(hit2.view(np.int8), model.one8, out=model.not2)
        np.subtract(hit.view(np.int8), model.one8, out=model.miss)
        np.subtract(now_code, model.shrink(now_size, x2, x1), out=now_code)
        now = np.where(hit2, model.named[m:], model.named[:m])
        rest = np.flatnonzero(~hit)
        if len(rest):
            step, left = size[rest] >> _U(12), code[rest]
            k = model.classes(np.minimum(left // step, _U(4095)).view(np.int64), rest)
            span = model.spans[k * m + rest]
            fine = (step * (span & 8191).view(_U)) >> _BITS[k].view(_U)
            left -= step * (span >> 13).view(_U)
            offset = left // fine
            code[rest], size[rest] = left - offset * fine, fine
            now[rest] = _FIRST[k] + offset.view(np.int64)
            model.met.append(k * lanes + rest)
        short = np.flatnonzero(now_size <= model.c[_SHORT])
        while len(short):
            of = at[short]
            code[short] = code[short] << _U(16) | words.take(of, mode="clip")
            at[short] = of + 1
            size[short] = wide = size[short] << _U(16)
            short = short[wide <= _U(_SHORT)]
        rows[t, :m] = now
        model.learn(now, model.named.reshape(2, m) == now)
    if int(rows.max()) >= len(alphabet) or int(rows.min()) < 0:
        raise ValueError("a rank is beyond the alphabet")
    symbols = alphabet[np.ascontiguousarray(rows.T).ravel()[:n_symbols]]
    pool, start, size = _spelt(tables)
    size = size[symbols]
    ends = np.cumsum(size)[np.minimum(np.arange(1, lanes + 1) * block, n_symbols) - 1].tolist()
    if ends[-1] != n:
        raise ValueError("a block is damaged")
    pieces = [slice(i, i + _PIECE) for i in range(0, n_symbols, _PIECE)]
    ids = np.concatenate([bpe.gather(pool, start[symbols[p]], size[p]) for p in pieces])
    for i, (a, b) in enumerate(zip([0, *ends], ends)):
        if zlib.crc32(ids[a:b]) != crc[i]:
            raise ValueError(f"block {i} fails its checksum")
    return ids


#: Words in a text that the library is asked for; bytes of text handled at once, so that fewer words are looked up again.
RUN_WORDS, SLICE_BYTES = 200, 2 << 20
#: Bytes with which white space may begin: ASCII's, and the first of U+0085, U+00A0, U+1680, U+2000 to U+205F and U+3000.
_SPACES = frozenset([*range(33), 0xC2, 0xE1, 0xE2, 0xE3])


class LibraryEncoder(bpe.Encoder):
    """Asks the ``tokenizers`` library for the ids of the words it hasn't met."""

    def __init__(self, path: str | None = None):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__(path)
        self.library = Tokenizer.from_file(bpe.vocabulary_path(path))
        self.library.no_truncation()
        self.library.no_padding()

        self.lengths = np.array([len(b) for b in self.vocabulary.bytes])

    def _learn(self, words: list[bytes]) -> None:
        """Words of a blank and other than white space are asked for as running text, as which the library
        splits them again; others one by one.  A word of half a character has no text of its own; those go to
        the base class.
        """
        spaced = [w for w in words if w[0] == 32 and len(w) > 1 and w[1] not in _SPACES]
        try:
            runs = [b"".join(spaced[i : i + RUN_WORDS]).decode() for i in range(0, len(spaced), RUN_WORDS)]
        except UnicodeDecodeError:
            spaced, runs = [], []
        if spaced:
            ids = [e.ids for e in self.library.encode_batch_fast(runs, add_special_tokens=False)]
            flat = np.fromiter(itertools.chain.from_iterable(ids), np.int32, sum(map(len, ids)))
            to, ends = np.cumsum(self.lengths[flat]), np.cumsum(np.fromiter(map(len, spaced), np.int64, len(spaced)))
            last = np.searchsorted(to, ends)
            if len(to) != last[-1] + 1 or (to[last] != ends).any():
                raise ValueError("the library's ids don't end where words do")
            self._keep(spaced, flat, np.diff(last, prepend=-1))
        alone, odd = [], []
        for w in words if not spaced else [w for w in words if w[0] != 32 or len(w) == 1 or w[1] in _SPACES]:
            try:
                alone.append(w.decode())
            except UnicodeDecodeError:
                odd.append(w)
        if odd:
            super()._learn(odd)
        if alone:
            self._store([t.encode() for t in alone], [e.ids for e in self.library.encode_batch_fast(alone, add_special_tokens=False)])


_libraries: dict[str | None, LibraryEncoder] = {}


def write(docs: DataFrame, end_id: int = 0, path: str | None = None) -> DataFrame:
    """Write the ids of ``docs`` (doc_id, text) in ascending doc_id; the frames, read from the files.

    Columns: shard (one for each written partition), frame, first (ids of the shard before the frame),
    n_ids, doc_ids and n_tokens (of its documents, in order), payload.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _libraries:
            _libraries[path] = LibraryEncoder(path)
        enc, shard = _libraries[path], TaskContext.get().partitionId()
        names, sizes, parts, held, first, frame = [], [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
            doc_ids = pa.concat_arrays(names)
            return pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in ((shard, pa.int32()), (frame, pa.int32()), (first, pa.int64()), (len(ids), pa.int64()))]
                + [pa.array([doc_ids.to_pylist()], pa.list_(doc_ids.type)), pa.array([np.concatenate(sizes)], pa.list_(pa.int64())), pa.array([pack(ids)], pa.binary())],
                ["shard", "frame", "first", "n_ids", "doc_ids", "n_tokens", "payload"],
            )

        for batch in batches:
            for a, b, data, bounds in bpe.text_slices(batch.column("text"), SLICE_BYTES):
                flat, at = enc.encode(data, bounds)
                flat = np.insert(flat, at[1:], end_id)
                names.append(batch.column("doc_id").slice(a, b - a))
                sizes.append(np.diff(at) + 1)
                parts.append(flat)
                held += len(flat)
                if held >= FRAME_IDS:
                    yield flush()
                    first, frame = first + held, frame + 1
                    names, sizes, parts, held = [], [], [], 0
        if names:
            yield flush()

    ordered = (
        docs.select("doc_id", F.col("text").cast("string").alias("text"))
        .withColumn("_tie", F.xxhash64("text"))
        .repartitionByRange("doc_id", "_tie")
        .sortWithinPartitions("doc_id", "_tie")
        .select("doc_id", "text")
    )
    frames = shared.mapped(ordered, run, f"shard int, frame int, first long, n_ids long, doc_ids array<{kind}>, n_tokens array<long>, payload binary")
    return shared.written(frames, "tokens")


def read(frames: DataFrame) -> DataFrame:
    """Each document of the frames: doc_id, start (ids of all documents before it), ids."""
    kind = frames.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _frames(batches):
            sizes, ids, start = row["n_tokens"], unpack(row["payload"]), row["first"]
            bounds = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))])
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array([row["shard"]] * len(sizes), pa.int32()), row["names"], pa.array(start + bounds[:-1]), lists], ["shard", "doc_id", "start", "ids"])

    return _placed(frames, shared.mapped(frames, run, f"shard int, doc_id {kind}, start long, ids array<int>"))


def _frames(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            one = batch.slice(i, 1)
            row = {c: one.column(c)[0].as_py() for c in ("shard", "first", "n_tokens", "payload")}
            yield row | {"names": one.column("doc_ids").flatten()}


def _placed(frames: DataFrame, docs: DataFrame) -> DataFrame:
    """Add what the shards before hold.  There is a row for each shard, and each was one task, so they fit a broadcast."""
    held = frames.groupBy("shard").agg(F.sum("n_ids").alias("_n"))
    before = held.select("shard", (F.sum("_n").over(Window.orderBy("shard")) - F.col("_n")).alias("_before"))
    return docs.join(F.broadcast(before), "shard").withColumn("start", F.col("start") + F.col("_before")).drop("shard", "_before")


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``docs``, read the files back: doc_id, start, n_tokens, ids_crc32."""
    frames = write(docs, 0, path)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _frames(batches):
            sizes, data = np.array(row["n_tokens"], np.int64), memoryview(unpack(row["payload"]).astype("<u4").tobytes())
            ends = np.cumsum(sizes)
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip((ends - sizes).tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array([row["shard"]] * len(sizes), pa.int32()), row["names"], pa.array(row["first"] + ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())], ["shard", "doc_id", "start", "n_tokens", "ids_crc32"])

    found = shared.mapped(frames, run, f"shard int, doc_id {kind}, start long, n_tokens long, ids_crc32 long")
    return _placed(frames, found).select("doc_id", "start", "n_tokens", "ids_crc32")
