"""Shingle sets and their HyperMinHash sketches, as array code for one batch of texts."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

BUCKET_BITS, MANTISSA_BITS = 8, 10
BUCKETS = 1 << BUCKET_BITS
_REST = 64 - BUCKET_BITS
# Fixed value: the share of bucket pairs with different minima whose registers agree all the
# same is about this constant over 2^MANTISSA_BITS (published for HyperMinHash).
COLLISION = 0.169919487159739 / (1 << MANTISSA_BITS)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; A-Z count as lower case.

    A text of fewer words than ``width`` is one shingle; without words the set is empty.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: the six blanks, A-Z only
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    short = len(words) < width
    width = min(width, len(words))
    # A short sequence starts from its length, so it equals no full shingle and no other length.
    total = np.full(len(words) - width + 1, len(words) if short else 0, np.uint64)
    for k in range(width):
        total = _mixed(total + hashes[k : len(hashes) - width + 1 + k] * np.uint64(2 * k + 1))
    return np.unique(total)


def digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def registers(shingles: np.ndarray) -> np.ndarray:
    """Per bucket the least hash as leading-zero count and mantissa in 16 bits; 0 is empty.

    The set is sorted, so the first hash of a bucket is its least one.
    """
    out = np.zeros(BUCKETS, np.uint16)
    buckets, first = np.unique(shingles >> np.uint64(_REST), return_index=True)
    x = shingles[first] & np.uint64((1 << _REST) - 1)
    exact = np.where(x >> np.uint64(53), x & ~np.uint64(255), x)  # what a double holds without rounding
    length = np.frexp(exact.astype(np.float64))[1].astype(np.uint64)
    mantissa = np.where(length > 0, x << (np.uint64(64) - np.maximum(length, np.uint64(1))), np.uint64(0))
    mantissa = (mantissa >> np.uint64(63 - MANTISSA_BITS)) & np.uint64((1 << MANTISSA_BITS) - 1)
    zeros = np.uint64(_REST) - length
    out[buckets.astype(np.int64)] = ((zeros + np.uint64(1)) << np.uint64(MANTISSA_BITS)) | mantissa
    return out


def band_keys(sketches: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """For each sketch (a row) the 64-bit key of every band, and whether the band has a shingle."""
    bands = sketches[:, : BUCKETS // rows * rows].reshape(len(sketches), -1, rows)
    key = np.tile(_mixed(np.arange(1, bands.shape[1] + 1, dtype=np.uint64)), (len(sketches), 1))
    for k in range(rows):
        key = _mixed(key ^ bands[:, :, k])
    return key.view(np.int64), bands.any(axis=2)


def estimate(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Jaccard estimates of sketch pairs, row by row, corrected for accidental agreement."""
    used = (left != 0) | (right != 0)
    n = np.maximum(used.sum(axis=1), 1)
    agree = ((left == right) & used).sum(axis=1)
    return np.clip((agree - n * COLLISION) / (n * (1 - COLLISION)), 0.0, 1.0)


def may_reach(left: np.ndarray, right: np.ndarray, share: float, sigmas: float) -> np.ndarray:
    """Whether pairs may reach ``share`` by a part of their registers, within ``sigmas`` deviations.

    Where few of these registers are used (small sets) the pair is let through.
    """
    used = ((left | right) != 0).sum(axis=1)
    agree = ((left == right) & (left != 0)).sum(axis=1)
    width = left.shape[1]
    floor = share - sigmas * np.sqrt(share * (1 - share) / width)
    return (4 * used < 3 * width) | (agree >= floor * used)
