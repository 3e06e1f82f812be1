"""Adaptive context-mixing range coder for ids of tokens or phrases, in checksummed blocks.

All blocks of a segment are coded in step by numpy, a block to a lane, and share one model that is
learned from all lanes. It holds predictions of three orders: the id that last followed the two ids
before (order 2), the one that last followed the id before (order 1), each with its confidence, and
for order 0 an adaptive distribution of magnitudes, two to each power of two. Coded is which of the
first two holds, or the magnitude. Its probabilities mix, by how much each has seen, a distribution
kept for the joint confidence of the higher orders with one kept for the segment. The bits of an id
below its magnitude have equal probabilities.

The range coder has 64-bit low and range and writes 32-bit words, one for an id at most.
"""

from __future__ import annotations

import zlib

import numpy as np

BLOCK = 512
#: Bits of the tables of order 2 and 1.
_B2, _B1 = 18, 16
HIT2, HIT1, _HITS = 0, 1, 2
#: Bits of coded frequencies, of symbols, and of ids at most (the least frequency's range has as many parts as a magnitude has ids).
_BITS, _SYMBOLS, MOST_BITS = 12, 6, 22
#: Contexts of the joint confidence; ids below so many bits are magnitudes of their own; steps between two mixings, after the first; weight of the segment's distribution.
_JOINT, _SMALL, _EVERY, _WEIGHT = 32, 4, 16, 24
_U, _V = np.uint64, np.uint32
_WORD, _LEAST, _SCALE = _U(32), _U(1 << 32), _U(_BITS)
_HASH, _HASH2 = _V(0x9E3779B1), _V(0x85EBCA6B)
#: Change of a table's entry, by hit and confidence; a miss of low confidence replaces it.
_CHANGE = np.array([0, 0, -1, -1, 1, 1, 1, 0]).astype(_V)


class CorruptBlock(ValueError):
    """A block's ids do not match its checksum."""


def _magnitudes(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """First id, and bits below, of each symbol; hits have none."""
    small = 1 << _SMALL
    halves = [(half << (e - 1), e - 1) for e in range(_SMALL, bits) for half in (2, 3)]
    first = [0] * _HITS + list(range(small)) + [f for f, _ in halves]
    return np.array(first, _V), np.array([0] * (_HITS + small) + [b for _, b in halves], _U)


class _Model:
    def __init__(self, lanes: int, bits: int):
        self.first, self.below = _magnitudes(bits)
        self.rest = ((_U(1) << self.below) - _U(1)).astype(_V)
        self.n = len(self.first)
        # entries of both orders, id << 2 | confidence, one table after the other
        self.table, self.at = np.zeros((1 << _B2) + (1 << _B1), _V), np.zeros((2, lanes), np.intp)
        self.m1 = self.m2 = np.zeros(lanes, _V)
        self.counts = np.zeros((_JOINT, 1 << _SYMBOLS), np.int64)
        self.keys: list[np.ndarray] = []
        self.t = 0
        self.mix()

    def mix(self) -> None:
        """Frequencies of the symbols in each context, out of 1 << _BITS."""
        if self.keys:
            self.counts += np.bincount(np.concatenate(self.keys), minlength=self.counts.size).reshape(self.counts.shape)
            self.keys = []
        own = self.counts[:, : self.n]
        whole = own.sum(0) + 1
        q = int(whole.sum())
        share = own * q + _WEIGHT * whole
        freq = 1 + share * ((1 << _BITS) - self.n) // ((own.sum(1) + _WEIGHT) * q)[:, None]
        freq[np.arange(_JOINT), freq.argmax(1)] += (1 << _BITS) - freq.sum(1)
        self.size, self.start = np.zeros(self.counts.shape, _U), np.zeros(self.counts.shape, _U)
        self.size[:, : self.n] = freq
        self.start[:, : self.n] = np.cumsum(freq, 1) - freq
        self.freq = freq

    def symbols(self) -> np.ndarray:
        """The symbol of each value below 1 << _BITS in each context."""
        return np.repeat(np.tile(np.arange(self.n, dtype=np.uint8), _JOINT), self.freq.ravel())

    def look(self) -> np.ndarray:
        """Predictions for the next id; the contexts."""
        np.right_shift((self.m1 ^ (self.m2 >> _V(5))) * _HASH2, _V(32 - _B2), out=self.at[0], casting="unsafe")
        np.add(self.m1 >> _V(32 - _B1), _V(1 << _B2), out=self.at[1], casting="unsafe")
        self.entry = self.table.take(self.at)
        self.seen, self.sure = self.entry >> _V(2), self.entry & _V(3)
        return (self.sure[0] << _V(3) | self.sure[1] << _V(1) | (self.seen[0] == self.seen[1])).astype(np.intp)

    def update(self, ids: np.ndarray, hits: np.ndarray, key: np.ndarray) -> bool:
        """Learn ids: with whether each higher order held, and the coded symbols in their contexts. True if frequencies are new."""
        state = self.sure + (hits.view(np.uint8) << np.uint8(2))
        # of lanes that share an entry the last one's stays
        self.table[self.at] = np.where(state < 2, ids << _V(2), self.entry + _CHANGE.take(state))
        self.m2, self.m1 = self.m1, ids * _HASH
        self.keys.append(key)
        self.t += 1
        if self.t % _EVERY and self.t & (self.t - 1):
            return False
        self.mix()
        return True

    def drop(self, lanes: int) -> None:
        """Go on with fewer lanes."""
        self.at, self.m1, self.m2 = self.at[:, :lanes].copy(), self.m1[:lanes], self.m2[:lanes]


def encode_blocks(ids: np.ndarray, bits: int = 16) -> tuple[list[bytes], list[int]]:
    """Coded bytes and crc32 of each block of ids (unsigned 32-bit, of so many bits)."""
    if not len(ids):
        return [], []
    if int(ids.max()) >= 1 << bits or not _SMALL < bits <= MOST_BITS:
        raise ValueError(f"ids of {bits} bits are coded, and {MOST_BITS} at most")
    lanes = -(-len(ids) // BLOCK)
    grid = np.zeros((lanes, BLOCK), _V)
    grid.ravel()[: len(ids)] = ids
    end = len(ids) - BLOCK * (lanes - 1)  # ids of the last block
    columns = np.ascontiguousarray(grid.T)
    del grid
    model = _Model(lanes, bits)
    magnitude = (np.searchsorted(model.first[_HITS:], np.arange(int(ids.max()) + 1), side="right") + _HITS - 1).astype(np.uint8)
    low, span = np.zeros(lanes, _U), np.full(lanes, 0xFFFFFFFFFFFFFFFF, _U)
    width = BLOCK + 4
    out = np.zeros((lanes, width), _V)  # word 0 takes a carry
    flat, ptr = out.ravel(), np.arange(lanes) * width + 1
    last = []
    for t in range(BLOCK if lanes > 1 else end):
        if t == end:
            last = [int(low[-1])]
            low, span, lanes = low[:-1].copy(), span[:-1].copy(), lanes - 1
            model.drop(lanes)
        now = columns[t, :lanes]
        context = model.look()
        hits = model.seen == now
        symbol = magnitude.take(now).astype(np.intp)
        np.putmask(symbol, hits[1], HIT1)
        np.putmask(symbol, hits[0], HIT2)
        key = context << _SYMBOLS | symbol
        r = span >> _SCALE
        span = r * model.size.take(key) >> model.below.take(symbol)
        new = low + (r * model.start.take(key) + span * (now & model.rest.take(symbol)))
        if (carry := np.flatnonzero(new < low)).size:
            at = ptr[carry] - 1
            flat[at] += _V(1)
            for j in at[flat[at] == 0].tolist():  # a word of all ones passes the carry on
                while flat[j] == 0:
                    j -= 1
                    flat[j] += _V(1)
        low = new
        if (need := np.flatnonzero(span < _LEAST)).size:
            at, word = ptr[need], low[need]
            flat[at] = word >> _WORD
            ptr[need] = at + 1
            low[need] = word << _WORD
            span[need] <<= _WORD
        model.update(now, hits, key)
    words = (ptr - np.arange(len(ptr)) * width).tolist()
    big = out.astype(">u4")
    blocks = [own[:n].tobytes() + bottom.to_bytes(8, "big") for own, n, bottom in zip(big, words, low.tolist() + last)]
    data = memoryview(ids.astype("<u4")).cast("B")
    return blocks, [zlib.crc32(data[lo : lo + 4 * BLOCK]) for lo in range(0, len(data), 4 * BLOCK)]


def decode_blocks(blocks: list[bytes], n: int, checks: list[int], bits: int = 16) -> np.ndarray:
    """The n ids, of so many bits, of the blocks; each block is held against its crc32."""
    lanes = len(blocks)
    if not lanes:
        return np.zeros(0, _V)
    longest = -(-max(map(len, blocks)) // 4) * 4 + 8
    words = np.frombuffer(b"".join([b.ljust(longest, b"\0") for b in blocks]), ">u4").astype(_V).reshape(lanes, -1)
    end = n - BLOCK * (lanes - 1)
    model = _Model(lanes, bits)
    symbols = model.symbols()
    # word 0 is the carry of the first word; low is kept at zero, so code is what lies above it
    code, span = words[:, 1].astype(_U) << _WORD | words[:, 2], np.full(lanes, 0xFFFFFFFFFFFFFFFF, _U)
    flat, ptr = words.ravel(), np.arange(lanes) * words.shape[1] + 3
    stop = ptr + (words.shape[1] - 4)  # the last word of a lane is padding
    grid = np.zeros((BLOCK, lanes), _V)
    top = _U((1 << _BITS) - 1)
    for t in range(BLOCK if lanes > 1 else end):
        if t == end:
            code, span, lanes = code[:-1].copy(), span[:-1].copy(), lanes - 1
            model.drop(lanes)
        context = model.look()
        r = span >> _SCALE
        value = np.minimum(code // r, top).view(np.int64)
        symbol = symbols.take(context << _BITS | value).astype(np.intp)
        key = context << _SYMBOLS | symbol
        code -= r * model.start.take(key)
        span = r * model.size.take(key) >> model.below.take(symbol)
        rest = np.minimum(code // span, model.rest.take(symbol))
        code -= span * rest
        now = model.first.take(symbol) + rest.astype(_V)
        now = np.where(symbol >= _HITS, now, np.where(symbol == HIT2, model.seen[0], model.seen[1]))
        if (need := np.flatnonzero(span < _LEAST)).size:
            at = ptr[need]
            code[need] = code[need] << _WORD | flat.take(np.minimum(at, stop[need]))
            ptr[need] = at + 1
            span[need] <<= _WORD
        grid[t, :lanes] = now
        if model.update(now, model.seen == now, key):
            symbols = model.symbols()
    ids = grid.T.ravel()[:n].copy()
    data = memoryview(ids.astype("<u4")).cast("B")
    for i, check in enumerate(checks):
        if zlib.crc32(data[4 * BLOCK * i : 4 * BLOCK * (i + 1)]) != check:
            raise CorruptBlock(f"block {i}")
    return ids
