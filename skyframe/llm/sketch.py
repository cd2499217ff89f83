"""Word-shingle sets, MinHash samples and odd sketches (NumPy kernels)."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import xxhash

#: Samples are 32-bit; an odd sketch folds them into this many bits.
SKETCH_BITS = 512
_U64 = np.uint64


class _Words(dict):
    """word -> dense number, with the word's 64-bit hash kept beside it."""

    def __init__(self) -> None:
        super().__init__()
        self.hashes: list[int] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.hashes)
        self.hashes.append(xxhash.xxh64_intdigest(word))
        return n


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased words, split at the six ASCII white-space bytes."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def sequence_key(words: list[bytes]) -> bytes:
    """128-bit identity of a word sequence: equal keys, equal shingle sets."""
    return hashlib.sha256(b" ".join(words)).digest()[:16]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U64(31))) * _U64(0x9E3779B97F4A7C15)
    return x ^ (x >> _U64(29))


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; short texts are one shingle."""
    n = len(hashes)
    if n == 0:
        return np.empty(0, _U64)
    span = min(width, n)
    out = np.full(n - span + 1, span, _U64)
    for k in range(span):
        out = _mix(out * _U64(0xC2B2AE3D27D4EB4F) + hashes[k : n - span + 1 + k])
    return np.unique(out)


def plan_bands(threshold: float, miss: float = 1e-7, samples: int = 240) -> tuple[int, int]:
    """(bands, rows): the most rows a band for which a pair at the threshold is
    missed by all bands with a probability of ``miss`` at most."""
    for rows in range(12, 0, -1):
        bands = samples // rows
        if (1 - threshold**rows) ** bands <= miss:
            return bands, rows
    return samples, 1


def sketch_limit(threshold: float, samples: int, sigmas: float = 6.0) -> int:
    """XOR population count above which a pair is below the threshold but for a
    deviation of ``sigmas`` (6: about 1e-9)."""
    n = SKETCH_BITS
    differ = samples * (1 - threshold)
    decay = math.exp(-4 * differ / n)
    mean = n / 2 * (1 - decay)
    sampled = 2 * decay * math.sqrt(samples * threshold * (1 - threshold))
    folded = math.sqrt(n / 4 * (1 - decay * decay))
    return math.ceil(mean + sigmas * math.hypot(sampled, folded))


class Sketcher:
    """Shingle counts, band keys and odd sketches of texts, the same in every process."""

    def __init__(self, width: int, bands: int, rows: int) -> None:
        self.width, self.bands, self.rows = width, bands, rows
        rng = np.random.Generator(np.random.PCG64(20240229))
        k = bands * rows
        self.xor = rng.integers(0, 2**32, k, dtype=np.uint32)
        self.mul = rng.integers(0, 2**32, k, dtype=np.uint32) | np.uint32(1)
        self.seat = _mix(rng.integers(1, 2**63, k, dtype=np.uint64))
        self.weight = rng.integers(1, 2**63, rows, dtype=np.uint64) | _U64(1)
        self.words = _Words()
        self._known = np.empty(0, _U64)

    def shingles(self, words: list[bytes]) -> np.ndarray:
        if len(self.words) > 60_000:  # bounds a worker's memory; numbers are never kept
            self.words, self._known = _Words(), np.empty(0, _U64)
        ids = list(map(self.words.__getitem__, words))
        if len(self._known) < len(self.words.hashes):
            more = self.words.hashes[len(self._known) :]
            self._known = np.concatenate([self._known, np.array(more, _U64)])
        return shingle_hashes(self._known[ids], self.width) if ids else np.empty(0, _U64)

    def samples(self, shingles: np.ndarray) -> np.ndarray:
        low = np.full(len(self.xor), 0xFFFFFFFF, np.uint32)
        h = (shingles >> _U64(32)).astype(np.uint32)
        for at in range(0, len(h), 1024):
            np.minimum(low, ((h[at : at + 1024, None] ^ self.xor) * self.mul).min(axis=0), out=low)
        return low

    def band_keys(self, samples: np.ndarray) -> np.ndarray:
        """One 64-bit key a band, the band's number mixed in."""
        x = samples.astype(_U64).reshape(self.bands, self.rows)
        with np.errstate(over="ignore"):
            mixed = _mix((_mix(x + _U64(1)) * self.weight).sum(axis=1, dtype=_U64) + np.arange(self.bands, dtype=_U64) * _U64(0xD6E8FEB86659FD93))
        return mixed.view(np.int64)

    def odd(self, samples: np.ndarray) -> np.ndarray:
        """Parity bitmap of the samples: bit b is the parity of those seated at b."""
        seats = (_mix(samples.astype(_U64) * self.seat + self.seat) >> _U64(40)) % _U64(SKETCH_BITS)
        return np.packbits((np.bincount(seats.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8))


def containment_counts(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """(intersection, union) sizes of two sorted distinct arrays."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both, len(a) + len(b) - both
