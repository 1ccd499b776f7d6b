"""HyperMinHash registers: per bucket the leading-zero count and some mantissa bits of the smallest hash in it."""

from __future__ import annotations

import math

import numpy as np

from .shingles import mix

BANDS, ROWS = 64, 5
BUCKETS = BANDS * ROWS
MANTISSA_BITS = 10
#: A register is zeros << MANTISSA_BITS | mantissa; zeros stop at 31, so that it fits 16 bits.
MAX_ZEROS = 31
#: Row i is bucket i's own order of all buckets, as ranks: an empty bucket takes the register of the filled bucket that
#: comes first in its order.
_RANK = mix(np.arange(BUCKETS * BUCKETS, dtype=np.uint64) + np.uint64(0x5851F42D4C957F2D)).reshape(BUCKETS, BUCKETS).argsort(axis=1).argsort(axis=1).astype(np.uint16)


def registers(hashes: np.ndarray) -> np.ndarray:
    """BUCKETS registers (uint16) of a non-empty set of 64-bit hashes. The bucket comes from the high bits, the value
    from the low 48; empty buckets borrow (densification), so every register samples the set's members."""
    bucket = ((hashes >> np.uint64(32)) * np.uint64(BUCKETS) >> np.uint64(32)).astype(np.int64)
    value = mix(hashes) >> np.uint64(16)
    least = np.full(BUCKETS, np.uint64(1 << 48))
    np.minimum.at(least, bucket, value)
    filled = least < np.uint64(1 << 48)
    # a float has the leading-zero count as its exponent and the mantissa in order
    part, exponent = np.frexp(np.maximum(least, np.uint64(1)).astype(np.float64))
    zeros = 48 - exponent
    mantissa = ((part * 2 - 1) * (1 << MANTISSA_BITS)).astype(np.int64)
    out = (np.minimum(zeros, MAX_ZEROS) << MANTISSA_BITS | mantissa).astype(np.uint16)
    if not filled.all():
        empty, full = np.flatnonzero(~filled), np.flatnonzero(filled)
        out[empty] = out[full[_RANK[empty[:, None], full].argmin(axis=1)]]
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of ROWS registers; the band's number is part of it."""
    r = regs.reshape(BANDS, ROWS).astype(np.uint64)
    key = mix(np.arange(BANDS, dtype=np.uint64) + np.uint64(0x2545F4914F6CDD1D))
    for i in range(ROWS):
        key = mix(key ^ r[:, i])
    return key.view(np.int64)


def chance_agreement(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Chance that a register of a set of n and one of a disjoint set of m agree: the sum, over the cells that a
    register can name, of both chances that the smallest of the bucket's values falls into that cell."""
    a, b = np.maximum(n / BUCKETS, 1e-9), np.maximum(m / BUCKETS, 1e-9)
    zeros = np.arange(MAX_ZEROS)[None, :]
    low, width = 2.0 ** -(zeros + 1), 2.0 ** -(zeros + 1 + MANTISSA_BITS)
    a, b = a[:, None], b[:, None]
    rate = a + b
    first = np.exp(-rate * low) * -np.expm1(-a * width) * -np.expm1(-b * width)
    cells = np.expm1(-rate * low) / np.expm1(-rate * width)  # a level is as wide as it is high: a geometric sum
    filled = np.expm1(-a) * np.expm1(-b)
    return ((first * cells).sum(axis=1) / filled[:, 0]).clip(0, 0.99)


def estimate(agree: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the number of agreeing registers, less the agreements that are due to chance."""
    chance = chance_agreement(np.asarray(n, float), np.asarray(m, float))
    return ((agree / BUCKETS - chance) / (1 - chance)).clip(0, 1)


#: Sets of fewer shingles than this are never ruled out by their registers, of which many are borrowed then.
LEAST_ESTIMATED = 4 * BUCKETS
#: exp(-2 BUCKETS SLACK^2) = 1e-9, Hoeffding's bound on the chance that BUCKETS independent registers of two sets agree less
#: often than the sets do by this much.
SLACK = math.sqrt(math.log(1e9) / (2 * BUCKETS))


def may_reach(agree: np.ndarray, n: np.ndarray, m: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the similarity may be reached: the sizes allow it, and, of sets that fill their registers, the estimate is
    not below it by more than SLACK."""
    n, m = np.asarray(n, float), np.asarray(m, float)
    small = np.minimum(n, m) < LEAST_ESTIMATED
    return (np.minimum(n, m) >= similarity * np.maximum(n, m)) & (small | (estimate(agree, n, m) >= similarity - SLACK))
