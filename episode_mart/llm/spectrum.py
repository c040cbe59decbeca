"""Leading eigenpairs of a symmetric matrix by spectrum slicing.

The inertia of ``a - s I``, read off a pivoted LDLᵀ factorization, counts the eigenvalues above ``s``
(Sylvester). Halving by counts leaves an interval with the one eigenvalue asked for; Rayleigh quotient
iteration, whose solves use the same factorization, then converges cubically, and counts on both sides
of the quotient certify its number. Eigenvalues closer than the rounding of ``a`` share an interval:
their vectors are found one after the other, each orthogonal to those before, and certified as a group.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

# Bunch and Parlett's bound of the growth of entries, (1 + sqrt 17) / 8.
_PIVOT = (1 + 17 ** 0.5) / 8
_EPS = np.finfo("float64").eps


class Factor(NamedTuple):
    """``a[order][:, order] = lower @ D @ lower.T``; ``blocks``: first index, size and inverse of D's blocks."""

    order: np.ndarray
    lower: np.ndarray
    blocks: list[tuple[int, int, np.ndarray]]
    positive: int


def factor(a: np.ndarray, tiny: float) -> Factor:
    """LDLᵀ with complete pivoting by blocks of one or two; pivots below ``tiny`` count as ``tiny``."""
    a, n = a.copy(), len(a)
    order, lower, blocks, positive, k = np.arange(n), np.eye(n), [], 0, 0
    while k < n:
        rest = np.abs(a[k:, k:])
        straight = int(rest.diagonal().argmax())
        beside = rest.copy()
        np.fill_diagonal(beside, 0)
        r, c = divmod(int(beside.argmax()), n - k)
        one = rest[straight, straight] >= _PIVOT * beside[r, c]
        for to, at in [(k, k + straight)] if one else [(k, k + min(r, c)), (k + 1, k + max(r, c))]:
            a[[to, at]] = a[[at, to]]
            a[:, [to, at]] = a[:, [at, to]]
            lower[[to, at], :k] = lower[[at, to], :k]
            order[[to, at]] = order[[at, to]]
        size = 1 if one else 2
        block = a[k:k + size, k:k + size]
        if one and abs(block[0, 0]) < tiny:
            block = np.array([[tiny]])
        inverse = np.linalg.inv(block)
        below = a[k + size:, k:k + size] @ inverse
        a[k + size:, k + size:] -= below @ a[k:k + size, k + size:]
        lower[k + size:, k:k + size] = below
        blocks.append((k, size, inverse))
        positive += 1 if size == 2 else int(block[0, 0] > 0)  # a block of two has one of each sign
        k += size
    return Factor(order, lower, blocks, positive)


def solve(f: Factor, b: np.ndarray) -> np.ndarray:
    y = b[f.order].copy()
    for k, size, _ in f.blocks:
        y[k + size:] -= f.lower[k + size:, k:k + size] @ y[k:k + size]
    for k, size, inverse in f.blocks:
        y[k:k + size] = inverse @ y[k:k + size]
    for k, size, _ in reversed(f.blocks):
        y[k:k + size] -= f.lower[k + size:, k:k + size].T @ y[k + size:]
    out = np.empty_like(y)
    out[f.order] = y
    return out


class Slicer:
    def __init__(self, a: np.ndarray):
        self.a, self.n = a, len(a)
        self.bound = float(np.abs(a).sum(axis=1).max(initial=0.0))  # Gershgorin: no eigenvalue lies beyond
        self.error = max(8 * self.n * _EPS * self.bound, np.finfo("float64").tiny)

    def factor(self, shift: float) -> Factor:
        return factor(self.a - shift * np.eye(self.n), self.error * _EPS)

    def above(self, shift: float) -> int:
        """How many eigenvalues lie above the shift."""
        return self.factor(shift).positive

    def isolate(self, number: int, low: float, high: float, counts: tuple[int, int]) -> tuple[float, float, int, int]:
        """Halve until only eigenvalue ``number`` (from 1, falling) lies between, or rounding ends it."""
        at_low, at_high = counts
        while at_low - at_high > 1 and high - low > self.error:
            middle = (low + high) / 2
            found = self.above(middle)
            if found >= number:
                low, at_low = middle, found
            else:
                high, at_high = middle, found
        return low, high, at_low, at_high

    def refine(self, low: float, high: float, before: np.ndarray, start: np.ndarray) -> tuple[float, np.ndarray] | None:
        """Rayleigh quotient iteration, orthogonal to ``before``; None if it leaves the interval."""
        shift, x, near = (low + high) / 2, start, False
        for _ in range(40):
            x = solve(self.factor(shift), x)
            x -= before @ (before.T @ x)
            x /= np.linalg.norm(x)
            quotient = float(x @ self.a @ x)
            residual = float(np.linalg.norm(self.a @ x - quotient * x))
            if near:  # one step beyond convergence, to the last digits
                return (quotient, x) if low - self.error <= quotient <= high + self.error else None
            near = residual <= self.error / 4
            # the quotient shifts once it is close; until then the interval's middle does
            if low < quotient < high and residual < (high - low):
                shift = quotient
        return None

    def leading(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Up to ``most`` largest eigenvalues that stand out of rounding, falling, and unit vectors by column."""
        values, vectors = [], np.empty((self.n, 0))
        random = np.random.default_rng(0)
        floor, ceiling = self.error, self.bound * (1 + 4 * _EPS) + self.error
        available = self.above(floor)
        for number in range(1, min(most, available) + 1):
            low, high, at_low, at_high = self.isolate(number, floor, ceiling, (available, 0))
            while True:
                start = random.standard_normal(self.n)
                found = self.refine(low, high, vectors, start - vectors @ (vectors.T @ start))
                if found and self.certain(number, found[0]):
                    break
                if high - low <= self.error:
                    raise ArithmeticError(f"eigenvalue {number} is not certified between {low} and {high}")
                middle = (low + high) / 2
                low, high = (middle, high) if self.above(middle) >= number else (low, middle)
            values.append(found[0])
            vectors = np.column_stack([vectors, found[1]])
        return np.array(values), vectors

    def certain(self, number: int, value: float) -> bool:
        """Fewer than ``number`` eigenvalues lie beyond the value, at least ``number`` from it on."""
        return self.above(value + self.error) < number <= self.above(value - self.error)
