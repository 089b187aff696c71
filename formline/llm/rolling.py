"""Rolling hashes over bytes in numpy, and the words of many texts as arrays."""

from __future__ import annotations

import numpy as np

#: Words are looked for in pieces of about so many bytes, cut at white space.
PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_RNG = np.random.default_rng(20240607)
VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_KEPT = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i mod 2**64 for i < n; what is kept for later is at most a few PIECEs long."""
    have = list(_KEPT)
    if len(have[0]) < n:
        m = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            p, step, done = np.empty(m, np.uint64), base, 1
            p[0] = 1
            while done < m:
                p[done : 2 * done] = p[:done] * np.uint64(step)
                step, done = step * step % 2**64, 2 * done
            have[k] = p
            if m <= 4 * PIECE:
                _KEPT[k] = p
    return have[0][:n], have[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _pieces(b: np.ndarray):
    """(start, end) of pieces that end with white space."""
    start = 0
    while start < len(b):
        end = start + PIECE
        while end < len(b) and not _SPACE[b[end - 1]]:
            step = _SPACE[b[end : end + PIECE]].nonzero()[0]
            end += int(step[0]) + 1 if len(step) else PIECE
        end = min(end, len(b))
        yield start, end
        start = end


class Words:
    """The words of texts, ASCII-lower-cased: ``raw`` bytes, ``start`` and ``end`` of each word in it, ``doc``, and a 64-bit ``hash``."""

    def __init__(self, texts: list[str]) -> None:
        parts = [t.encode("utf-8", "surrogatepass") for t in texts]
        self.raw = b"\n".join([*parts, b""]).lower()
        b = np.frombuffer(self.raw, np.uint8)
        starts, ends, hashes = [], [], []
        for a, z in _pieces(b):
            part = b[a:z]
            word = ~_SPACE[part]
            turn = np.diff(word.astype(np.int8), prepend=0, append=0)
            s, e = (turn == 1).nonzero()[0], (turn == -1).nonzero()[0]
            power, inverse = powers(len(part) + 1)
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(VALUE[part] * power[: len(part)], out=total[1:])
            hashes.append(mixed((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))
            starts.append(s + a)
            ends.append(e + a)
        none = np.zeros(0, np.int64)
        self.start, self.end = np.concatenate([none, *starts]), np.concatenate([none, *ends])
        self.hash = np.concatenate([none.view(np.uint64), *hashes]).view(np.int64)
        at = np.cumsum([0, *(len(p) + 1 for p in parts)])
        self.doc = np.searchsorted(at, self.start, "right") - 1
        self.n_docs = len(texts)

    def joined(self, which: np.ndarray) -> bytes:
        """The chosen words' bytes, a space before each."""
        size = self.end[which] - self.start[which] + 1
        b = np.frombuffer(self.raw, np.uint8)
        out = b[np.minimum(ragged(self.start[which] - 1, size), len(b) - 1)]
        out[np.cumsum(size) - size] = 32
        return out.tobytes()


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for size[0] places, then the same of start[1], ..."""
    total = int(size.sum())
    return np.arange(total) + np.repeat(start - (np.cumsum(size) - size), size)
