"""Whole numbers of any size for clustering: floors of scaled components, exact distances, sums that merge.

Arrays of ints are int64 where every squared distance between them is sure to fit, else Python ints."""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np

LONGEST = 2**63 - 1
#: Sums travel as digits of so many bits, the last one signed: they can be added up digit by digit over 2**31 tasks.
DIGIT = 32


def limit(dims: int) -> int:
    """Squared distances of vectors of so many components, none beyond this, fit in a long."""
    return math.isqrt(LONGEST // max(dims, 1)) // 2


def floors(x: np.ndarray, scale: int, dims: int) -> np.ndarray:
    """floor(scale * x), exact; scale is a power of two, so the product in double precision is exact too."""
    x = np.asarray(x, np.float64)
    with np.errstate(over="ignore"):
        y = np.floor(x * scale)
    if not y.size or np.abs(y).max() <= limit(dims):
        return y.astype(np.int64)
    whole = [math.floor(v * scale) if abs(v) < 2**53 else int(v) * scale for v in x.ravel().tolist()]
    return np.array(whole, object).reshape(x.shape)


def alike(a: np.ndarray, b: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Both as int64 if all squared distances fit, else both as Python ints."""
    if a.dtype != object and b.dtype != object:
        return a, b
    fits = all(not x.size or max(abs(v) for v in x.ravel().tolist()) <= limit(dims) for x in (a, b))
    return (a.astype(np.int64), b.astype(np.int64)) if fits else (a.astype(object), b.astype(object))


def settled(values: list[list[int]], dims: int) -> np.ndarray:
    """Rows of whole numbers as an array in the kind that their size asks for."""
    out = np.array(values, object).reshape(len(values), dims)
    return out.astype(np.int64) if all(abs(v) <= limit(dims) for row in values for v in row) else out


def digits(values: Iterable[int]) -> list[list[int]]:
    """Whole numbers as lists of digits, lowest first, as many lists as the largest needs."""
    rest, out = [int(v) for v in values], []
    while any(not -(2**31) <= v < 2**31 for v in rest):
        out.append([v & (2**DIGIT - 1) for v in rest])
        rest = [v >> DIGIT for v in rest]
    return [*out, rest]


def number(parts: dict[int, int]) -> int:
    """The whole number that digits (place -> digit, or a sum of digits) make up."""
    return sum(v << DIGIT * k for k, v in parts.items())


def as_long(v: int | None) -> int | None:
    """v, or None where it is beyond a long."""
    return v if v is not None and -LONGEST - 1 <= v <= LONGEST else None
