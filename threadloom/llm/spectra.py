"""Eigendecompositions that grow by rank-one updates.

``vectors @ diag(values) @ vectors.T`` plus ``v @ v.T`` has as its eigenvalues
the roots of the secular equation ``1 + sum(z_j**2 / (values_j - root)) = 0``
with ``z = vectors.T @ v``: one root above each old value and below the next.
Values whose ``z`` vanishes keep their vector and value, and of two values that
hardly differ a rotation makes one ``z`` vanish (deflation). The roots are
measured from their nearest old value, which keeps the differences exact, and
the vectors come from the ``z`` that has just these roots, which keeps them
orthogonal however close the roots lie.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

EPS = np.finfo(float).eps
ROUNDS = 80


@dataclass
class Spectrum:
    """Count, mean and scatter of some vectors; the scatter by eigenvalues, rising, and columns of vectors."""

    n: int
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, width: int) -> Spectrum:
        return cls(0, np.zeros(width), np.zeros(width), np.eye(width))

    def add(self, x: np.ndarray) -> None:
        """One more vector: the scatter grows by its distance from the mean."""
        away = x - self.mean
        self.n += 1
        self.values, self.vectors = rank_one(self.values, self.vectors, away * np.sqrt((self.n - 1) / self.n))
        self.mean = self.mean + away / self.n

    def join(self, other: Spectrum) -> None:
        """All vectors of another: one update for each of its eigenvectors, one for the means."""
        if not other.n:
            return
        scaled = other.vectors * np.sqrt(np.maximum(other.values, 0.0))
        for v in scaled.T[other.values > 0]:
            self.values, self.vectors = rank_one(self.values, self.vectors, v)
        total, away = self.n + other.n, other.mean - self.mean
        across = away * np.sqrt(self.n / total * other.n)
        self.values, self.vectors = rank_one(self.values, self.vectors, across)
        self.mean, self.n = self.mean + away * (other.n / total), total


def secular_roots(d: np.ndarray, z2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots as (place of the nearest ``d``, distance from it); ``d`` rising and apart, ``z2`` above zero."""
    k = len(d)
    upper = np.append(d[1:], d[-1] + z2.sum())
    gap = upper - d
    steps = d[None, :] - d[:, None]  # from each root's lower value to all values
    # the sign in the middle tells which of the two values is nearer
    at_middle = 1 + (z2 / (steps - 0.5 * gap[:, None])).sum(axis=1)
    right = (at_middle < 0) & (np.arange(k) < k - 1)
    origin = np.arange(k) + right
    steps = d[None, :] - d[origin][:, None]
    low = np.where(right, -0.5 * gap, 0.0)
    high = np.where(right, 0.0, np.where(at_middle < 0, gap, 0.5 * gap))
    low = np.where(~right & (at_middle < 0), 0.5 * gap, low)
    to_low = np.where(right, -gap, 0.0)  # the two values around the root, from its origin
    to_high = np.where(right, 0.0, gap)
    root = 0.5 * (low + high)
    below = np.arange(k)[None, :] <= np.arange(k)[:, None]
    for _ in range(ROUNDS):
        inverse = 1.0 / (steps - root[:, None])
        terms = z2 * inverse
        slopes = terms * inverse
        f = 1.0 + terms.sum(axis=1)
        done = np.abs(f) <= 4 * EPS * k * (1.0 + np.abs(terms).sum(axis=1))
        if done.all():
            break
        low, high = np.where(f < 0, root, low), np.where(f > 0, root, high)
        # a rational function with poles at both neighbours that meets value and slopes
        psi = (slopes * below).sum(axis=1)
        phi = slopes.sum(axis=1) - psi
        left, gone = to_low - root, to_high - root
        c = f - left * psi - gone * phi
        a = (left + gone) * f - left * gone * (psi + phi)
        b = left * gone * f
        with np.errstate(divide="ignore", invalid="ignore"):
            wide = np.sqrt(np.maximum(a * a - 4 * b * c, 0.0))
            step = np.where(a <= 0, (a - wide) / (2 * c), 2 * b / (a + wide))
        moved = root + step
        inside = np.isfinite(moved) & (moved > low) & (moved < high)
        moved = np.where(inside, moved, 0.5 * (low + high))
        still = done | (moved == root)
        if still.all():
            break
        root = np.where(done, root, moved)
    return origin, root


def rank_one(values: np.ndarray, vectors: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, rising, and eigenvectors after adding ``v @ v.T``."""
    z = vectors.T @ v
    size = float(z @ z)
    if not size:
        return values, vectors
    tol = 8 * EPS * max(float(values[-1]), size)
    active = np.abs(z) * np.sqrt(size) > tol
    kept = np.flatnonzero(active)
    if len(kept) > 1 and (np.diff(values[kept]) * np.abs(z[kept[1:]] * z[kept[:-1]]) <= tol * (z[kept[1:]] ** 2 + z[kept[:-1]] ** 2)).any():
        values, vectors, z = values.copy(), vectors.copy(), z.copy()
        last = kept[0]
        for j in kept[1:]:
            r = np.hypot(z[last], z[j])
            c, s = z[j] / r, z[last] / r
            if (values[j] - values[last]) * abs(c * s) <= tol:
                vectors[:, [last, j]] = vectors[:, [last, j]] @ np.array([[c, s], [-s, c]])
                z[last], z[j] = 0.0, r
                # the rotation turns the values, too; what it leaves beside them is within the tolerance
                a, b = values[last], values[j]
                values[last], values[j] = a * c * c + b * s * s, a * s * s + b * c * c
                active[last] = False
            last = j
        kept = np.flatnonzero(active)
    if not len(kept):
        return values, vectors
    d, z = values[kept], z[kept]
    origin, root = secular_roots(d, z * z)
    found = d[origin] + root
    # root i less value j, exact as far as the numbers are
    less = root[:, None] + (d[origin][:, None] - d[None, :])
    # Loewner's formula: the z whose secular equation has just these roots
    k = len(d)
    among = d[:, None] - d[None, :]
    ratio = less.copy()
    rows = np.arange(k)
    # root i pairs with value i + 1 for columns above it, with value i below it
    upper = rows[:, None] < rows[None, :]
    np.divide(ratio, among, out=ratio, where=upper)
    shifted = np.zeros_like(ratio)
    shifted[:-1] = among[1:]
    np.divide(ratio, shifted, out=ratio, where=(rows[:, None] >= rows[None, :]) & (rows[:, None] < k - 1))
    exact = np.sqrt(np.abs(ratio.prod(axis=0))) * np.sign(z)
    turned = exact[:, None] / -less.T
    turned /= np.linalg.norm(turned, axis=0)
    values, made = values.copy(), vectors[:, kept] @ turned
    vectors = vectors.copy()
    values[kept], vectors[:, kept] = found, made
    if (np.diff(values) < 0).any():
        order = np.argsort(values, kind="stable")
        values, vectors = values[order], vectors[:, order]
    return values, vectors
