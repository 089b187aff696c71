"""Counting quotient filters over packed n-grams of word ids, lossless.

A key of ``k`` ids of ``width`` bits is two halves of equal size.  A Feistel network permutes it, so keys
spread evenly over all values and the permuted key still is the key.  A filter holds permuted keys in
order: the first bits (the quotient) only as run lengths in unary, the rest (the full remainder) in
whole bytes, and a counter of one byte, with the few larger ones apart.  Nothing is hashed away, so
counts are exact and filters of shards merge like sorted lists.
"""

from __future__ import annotations

import struct

import numpy as np

from formline.llm.rolling import mixed

_ROUNDS = tuple(np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
_HEAD = struct.Struct("<qBBB")
_FULL = 255

Keys = tuple[np.ndarray, np.ndarray]


def half_bits(k: int, width: int) -> int:
    """Bits of each half of a key."""
    return (k * width + 1) // 2


def _mask(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


def pack(ids: list[np.ndarray], width: int) -> Keys:
    """The halves of each key from the ids at each place of it; ids are under 2 ** width, width at most 32."""
    half = half_bits(len(ids), width)
    high = low = np.zeros(len(ids[0]), np.uint64)
    for place, x in enumerate(ids):
        shift = (len(ids) - 1 - place) * width
        x = x.astype(np.uint64)
        if shift >= half:
            high = high | x << np.uint64(shift - half)
        else:
            low = low | x << np.uint64(shift) & _mask(half)
            if shift + width > half:
                high = high | x >> np.uint64(half - shift)
    return high, low


def unpack(keys: Keys, k: int, width: int) -> list[np.ndarray]:
    half = half_bits(k, width)
    high, low = keys
    out = []
    for place in range(k):
        shift = (k - 1 - place) * width
        if shift >= half:
            x = high >> np.uint64(shift - half)
        else:
            x = low >> np.uint64(shift)
            if shift + width > half:
                x = x | high << np.uint64(half - shift)
        out.append((x & _mask(width)).astype(np.int64))
    return out


def permute(keys: Keys, half: int) -> Keys:
    """Invertible, over all keys of two such halves."""
    a, b = keys
    drop = np.uint64(64 - half)
    for c in _ROUNDS:
        a, b = b, a ^ (mixed(b + c) >> drop)
    return a, b


def restore(keys: Keys, half: int) -> Keys:
    a, b = keys
    drop = np.uint64(64 - half)
    for c in reversed(_ROUNDS):
        a, b = b ^ (mixed(a + c) >> drop), a
    return a, b


def counted(keys: Keys, counts: np.ndarray | None, half: int) -> tuple[Keys, np.ndarray]:
    """Distinct keys in order, with the sums of their counts (of 1 each)."""
    a, b = keys
    n = len(a)
    if not n:
        return keys, np.zeros(0, np.int64)
    if 2 * half <= 64:
        whole = a << np.uint64(half) | b
        if counts is None:
            whole.sort()
        else:
            order = np.argsort(whole)
            whole, counts = whole[order], counts[order]
        first = np.concatenate([[True], whole[1:] != whole[:-1]]).nonzero()[0]
        whole = whole[first]
        keys = whole >> np.uint64(half), whole & _mask(half)
    else:
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        first = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]).nonzero()[0]
        counts = None if counts is None else counts[order]
        keys = a[first], b[first]
    if counts is None:
        return keys, np.diff(np.append(first, n)).astype(np.int64)
    return keys, np.add.reduceat(counts, first)


def _bytes_of(x: np.ndarray, size: int) -> np.ndarray:
    return np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :size]


def encode(keys: Keys, counts: np.ndarray, half: int, skip: int = 0) -> bytes:
    """A filter of permuted, distinct keys in order, which agree in their first ``skip`` bits."""
    a, b = keys
    n, free = len(a), half - skip
    rest = min(-(-max(free - max(n.bit_length() - 1, 0), 0) // 8) * 8, free)
    quotient = free - rest
    a = a & _mask(free)
    runs = np.zeros(n + (1 << quotient), bool)
    runs[(a >> np.uint64(rest)).astype(np.int64) + np.arange(n)] = True
    remainder = np.concatenate([_bytes_of(a & _mask(rest), -(-rest // 8)), _bytes_of(b, -(-half // 8))], 1)
    large = counts >= _FULL
    small = np.where(large, _FULL, counts).astype(np.uint8)
    return b"".join([_HEAD.pack(n, half, skip, quotient), np.packbits(runs).tobytes(), remainder.tobytes(), small.tobytes(), counts[large].astype("<i8").tobytes()])


def decode(raw: bytes, prefix: int = 0) -> tuple[Keys, np.ndarray]:
    """Keys and counts of a filter; ``prefix`` has the bits that its keys agree in."""
    n, half, skip, quotient = _HEAD.unpack_from(raw)
    data = np.frombuffer(raw, np.uint8)
    at = _HEAD.size
    rest = half - skip - quotient
    size = n + (1 << quotient)
    runs = np.unpackbits(data[at : at + -(-size // 8)], count=size).nonzero()[0] - np.arange(n)
    at += -(-size // 8)
    x, y = -(-rest // 8), -(-half // 8)
    wide = np.zeros((2, n, 8), np.uint8)
    table = data[at : at + n * (x + y)].reshape(n, x + y)
    wide[0, :, :x], wide[1, :, :y] = table[:, :x], table[:, x:]
    a, b = wide.view("<u8")[:, :, 0].astype(np.uint64)
    at += n * (x + y)
    counts = data[at : at + n].astype(np.int64)
    counts[counts == _FULL] = np.frombuffer(raw, "<i8", offset=at + n)
    return (a | runs.astype(np.uint64) << np.uint64(rest) | np.uint64(prefix << (half - skip)), b), counts


def merged(parts: list[tuple[Keys, np.ndarray]], half: int) -> tuple[Keys, np.ndarray]:
    """The sum of filters' keys and counts."""
    keys = tuple(np.concatenate([p[0][i] for p in parts]) for i in (0, 1))
    return counted(keys, np.concatenate([p[1] for p in parts]), half)
