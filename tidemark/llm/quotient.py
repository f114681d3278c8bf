"""Counting quotient filters without loss: sorted, compact counters of packed word-id phrases.

A phrase of n word ids of b bits is packed into 64-bit lanes, as many whole ids per lane as fit, and the lanes are permuted
by rounds that each can be undone. The permuted key spreads evenly, whatever the words. Its highest bits number the *shard*, the
next ones are the *quotient*, an implicit slot, and all others the *remainder*, which is kept in full: a filter stores how many entries
each slot has, the remainders in order and the counts, and gives every key back exactly. Filters of one shard merge like sorted runs.
"""

from __future__ import annotations

import struct

import numpy as np

from tidemark.llm.common import U64, mix

#: Odd multipliers of the rounds, from a fixed seed.
MULTIPLIERS = [int(m) | 1 for m in np.random.default_rng(20240621).integers(1, 1 << 62, 8)]
ROUNDS = 2


class Layout:
    """How phrases of n ids of b bits lie in lanes, and the permutation of the lanes."""

    def __init__(self, n: int, bits: int):
        if not 1 <= bits <= 32:
            raise ValueError("word ids take 1 to 32 bits")
        self.n, self.bits, per = n, bits, 64 // bits
        self.spans = [(i, min(i + per, n)) for i in range(0, n, per)]
        self.widths = [(z - a) * bits for a, z in self.spans]
        self.masks = [U64((1 << w) - 1) for w in self.widths]

    def pack(self, words: list[np.ndarray]) -> list[np.ndarray]:
        """Lanes of phrases whose i-th ids stand in words[i]."""
        lanes = []
        for a, z in self.spans:
            lane = np.zeros(len(words[0]), U64)
            for i in range(a, z):
                lane = (lane << U64(self.bits)) | words[i].astype(U64)
            lanes.append(lane)
        return lanes

    def unpack(self, lanes: list[np.ndarray]) -> np.ndarray:
        """Ids as a matrix, a row per phrase."""
        out = np.empty((len(lanes[0]), self.n), np.int64)
        for lane, (a, z) in zip(lanes, self.spans):
            for i in range(a, z):
                out[:, i] = (lane >> U64(self.bits * (z - 1 - i))) & U64((1 << self.bits) - 1)
        return out

    def _others(self, lanes: list[np.ndarray], i: int, turn: int) -> np.ndarray:
        h = np.full(len(lanes[0]), turn * 8 + i + 1, U64)
        for j, lane in enumerate(lanes):
            if j != i:
                h = mix(h ^ lane)
        return h & self.masks[i]

    def permute(self, lanes: list[np.ndarray]) -> list[np.ndarray]:
        lanes = list(lanes)
        for turn in range(ROUNDS):
            for i, (w, mask) in enumerate(zip(self.widths, self.masks)):
                if len(lanes) > 1:
                    lanes[i] = lanes[i] ^ self._others(lanes, i, turn)
                for m in MULTIPLIERS[turn * 2:turn * 2 + 2]:
                    lanes[i] = (lanes[i] * U64(m)) & mask
                    lanes[i] = lanes[i] ^ (lanes[i] >> U64((w + 1) // 2))
        return lanes

    def restore(self, lanes: list[np.ndarray]) -> list[np.ndarray]:
        """The lanes before ``permute``."""
        lanes = list(lanes)
        for turn in reversed(range(ROUNDS)):
            for i, (w, mask) in reversed(list(enumerate(zip(self.widths, self.masks)))):
                for m in reversed(MULTIPLIERS[turn * 2:turn * 2 + 2]):
                    lanes[i] = lanes[i] ^ (lanes[i] >> U64((w + 1) // 2))
                    lanes[i] = (lanes[i] * U64(pow(m, -1, 1 << 64))) & mask
                if len(lanes) > 1:
                    lanes[i] = lanes[i] ^ self._others(lanes, i, turn)
        return lanes

    def shard_bits(self, wanted: int) -> int:
        """Bits of the shard number for at least ``wanted`` shards, as far as the key has them."""
        return min(max(wanted - 1, 0).bit_length(), self.widths[0])

    def shard(self, lanes: list[np.ndarray], s: int) -> np.ndarray:
        return (lanes[0] >> U64(self.widths[0] - s) if s else np.zeros(len(lanes[0]), U64)).astype(np.int64)


def _ordered(lanes: list[np.ndarray]) -> np.ndarray:
    return np.argsort(lanes[0], kind="stable") if len(lanes) == 1 else np.lexsort(lanes[::-1])


def counted(lanes: list[np.ndarray], counts: np.ndarray | None = None, places: bool = False):
    """Distinct keys in order with their sums of counts; on demand also the place of each input key among them."""
    order = _ordered(lanes)
    lanes = [lane[order] for lane in lanes]
    n = len(order)
    new = np.ones(n, bool)
    if n:
        new[1:] = False
        for lane in lanes:
            new[1:] |= lane[1:] != lane[:-1]
    at = np.flatnonzero(new)
    sums = (np.diff(np.append(at, n)) if counts is None else np.add.reduceat(counts[order], at)) if n else np.zeros(0, np.int64)
    out = [lane[at] for lane in lanes], sums.astype(np.int64)
    if not places:
        return out
    where = np.empty(n, np.int64)
    where[order] = np.cumsum(new) - 1
    return *out, where


def _narrow(values: np.ndarray, bits: int) -> bytes:
    """Numbers of so many bits in as few whole bytes each."""
    size = -(-bits // 8)
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]).tobytes()


def _wide(raw: bytes, bits: int, m: int) -> np.ndarray:
    size = -(-bits // 8)
    out = np.zeros((m, 8), np.uint8)
    out[:, :size] = np.frombuffer(raw, np.uint8, m * size).reshape(m, size)
    return out.view("<u8").ravel()


def dump(layout: Layout, lanes: list[np.ndarray], counts: np.ndarray, s: int) -> bytes:
    """The filter of one shard's distinct sorted keys."""
    m, rest = len(counts), layout.widths[0] - s
    t = min(rest, max(m.bit_length() - 1, 0))
    inside = lanes[0] & U64((1 << rest) - 1)
    runs = np.bincount((inside >> U64(rest - t)).astype(np.int64), minlength=1 << t)
    wide_runs = int(runs.max(initial=0)) > 255
    large = np.flatnonzero(counts > 254)
    small = np.minimum(counts, 255).astype(np.uint8)
    parts = [struct.pack("<IBBI", m, t, wide_runs, len(large)), runs.astype("<u4" if wide_runs else np.uint8).tobytes(), _narrow(inside & U64((1 << (rest - t)) - 1), rest - t)]
    parts += [_narrow(lane, w) for lane, w in zip(lanes[1:], layout.widths[1:])]
    return b"".join([*parts, small.tobytes(), counts[large].astype("<i8").tobytes()])


def load(layout: Layout, raw: bytes, shard: int, s: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Keys and counts of a filter."""
    m, t, wide_runs, n_large = struct.unpack_from("<IBBI", raw)
    at, rest = struct.calcsize("<IBBI"), layout.widths[0] - s

    def take(size):
        nonlocal at
        at += size
        return raw[at - size:at]
    runs = np.frombuffer(take((1 << t) * (4 if wide_runs else 1)), "<u4" if wide_runs else np.uint8)
    remainder = _wide(take(m * -(-(rest - t) // 8)), rest - t, m)
    slot = np.repeat(np.arange(1 << t, dtype=U64), runs)
    lanes = [remainder | (slot << U64(rest - t) if rest > t else slot) | (U64(shard) << U64(rest) if s else U64(0))]
    lanes += [_wide(take(m * -(-w // 8)), w, m) for w in layout.widths[1:]]
    counts = np.frombuffer(take(m), np.uint8).astype(np.int64)
    counts[counts == 255] = np.frombuffer(take(8 * n_large), "<i8")
    return lanes, counts


def merge(filters: list[tuple[list[np.ndarray], np.ndarray]], places: bool = False):
    """The sorted filters as one, counts of equal keys added."""
    lanes = [np.concatenate(parts) for parts in zip(*(f[0] for f in filters))]
    return counted(lanes, np.concatenate([f[1] for f in filters]), places)
