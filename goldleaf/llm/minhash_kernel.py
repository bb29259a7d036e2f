"""Shingles and circulant MinHash signatures of single documents, in numpy."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

U32, U64 = np.uint32, np.uint64

#: Multipliers and shifts of the public 32-bit and 64-bit MurmurHash3 finalizers (bijections).
FMIX32 = (16, 0x85EBCA6B, 13, 0xC2B2AE35, 16)
FMIX64 = (33, 0xFF51AFD7ED558CCD, 33, 0xC4CEB9FE1A85EC53, 33)

#: Shingles of one document that are permuted at a time.
CHUNK = 1024


def mix64(x: np.ndarray) -> np.ndarray:
    s1, m1, s2, m2, s3 = FMIX64
    x = x ^ (x >> U64(s1))
    x = x * U64(m1)
    x ^= x >> U64(s2)
    x *= U64(m2)
    x ^= x >> U64(s3)
    return x


def _mix32_in_place(x: np.ndarray, spare: np.ndarray) -> None:
    s1, m1, s2, m2, s3 = FMIX32
    for shift, factor in ((s1, m1), (s2, m2), (s3, None)):
        np.right_shift(x, U32(shift), out=spare)
        np.bitwise_xor(x, spare, out=x)
        if factor is not None:
            np.multiply(x, U32(factor), out=x)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text.

    A-Z are lower-cased; words are runs of anything but space and U+0009 to U+000D. A text of
    fewer than ``width`` words has its whole sequence as one shingle; one without words has none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, U64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b"\x00" + b" ".join(words), 1)], U64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), U64, len(words))
    n = len(words) - width + 1
    out = np.zeros(n, U64)
    for k in range(width):  # order matters: each place has its own mixing
        out = mix64(out + h[k : k + n] + U64(k + 1))
    return np.unique(out)


def set_digest(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that name a shingle set."""
    hi, lo = np.frombuffer(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest(), np.int64)
    return int(hi), int(lo)


def signature(shingles: np.ndarray, size: int) -> np.ndarray:
    """Circulant MinHash: coordinate k is the minimum of pi(sigma(x) + k) over the set, modulo 2**32.

    sigma, the first permutation, scatters the shingles over the circle of 2**32 places; pi, the
    second one, is shifted by k places for coordinate k, so two permutations make all coordinates.
    """
    placed = (mix64(shingles ^ U64(0x9E3779B97F4A7C15)) >> U64(32)).astype(U32)
    shifts = np.arange(size, dtype=U32)
    least = np.full(size, 0xFFFFFFFF, U32)
    for at in range(0, len(placed), CHUNK):
        x = placed[at : at + CHUNK, None] + shifts[None, :]
        _mix32_in_place(x, np.empty_like(x))
        np.minimum(least, x.min(axis=0), out=least)
    return least


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One signed 64-bit key for each band; equal keys mean equal bands of the same number."""
    out = np.arange(1, bands + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)
    grid = sig[: bands * rows].reshape(bands, rows).astype(U64)
    for j in range(rows):
        out = mix64(out + grid[:, j] + U64(j))
    return out.view(np.int64)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())
