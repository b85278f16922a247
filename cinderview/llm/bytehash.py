"""Hashes of many spans of a byte buffer at once.

A polynomial hash over prefix sums (arithmetic modulo 2**64): the hash of any span
is one subtraction and one product, so words, n-grams and windows of a whole Arrow
batch cost a few numpy operations each.
"""

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(n):
    """``BASE ** i`` and ``BASE ** -i`` for i below ``n``."""
    global _powers
    if len(_powers[0]) < n:
        grown = max(n, 1 << 16)
        out = []
        for factor in (BASE, INVERSE):
            p = np.full(grown, factor, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers = tuple(out)
    return _powers[0][:n], _powers[1][:n]


def prefix_sums(data):
    up, _ = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return sums


def span_hashes(sums, starts, ends):
    """Hash of every span ``[start, end)``; equal bytes have equal hashes wherever they stand."""
    _, down = powers(len(sums))
    return mixed((sums[ends] - sums[starts]) * down[starts])


def mixed(x):
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(classes, starts, ends):
    """Maximal runs of one non-zero class that do not cross rows: ``(start, end)``."""
    n = len(classes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    change = np.empty(n + 1, bool)
    change[0] = change[n] = True
    change[1:n] = classes[1:] != classes[:-1]
    change[starts[starts < n]] = True
    bounds = np.flatnonzero(change)
    keep = classes[bounds[:-1]] != 0
    return bounds[:-1][keep], bounds[1:][keep]


def words(data, starts, ends):
    """Runs of bytes other than ASCII white space, and the row of each."""
    first, last = runs((~SPACE[data]).astype(np.uint8), starts, ends)
    return first, last, np.searchsorted(ends, first, side="right")


def row_sums(values, rows, n):
    """Sum of ``values`` for each of ``n`` rows."""
    return np.bincount(rows, weights=values, minlength=n)
