"""Leading eigenpairs of a symmetric matrix by contour integration (FEAST), with inertia counts as proof that none is missed.

The projector on the eigenvectors of an interval is the integral of the resolvent along a circle around it. Quadrature turns it into a
sum of solves with complex shifts; Rayleigh-Ritz on what the sum gives extracts the pairs. The number of eigenvalues above a
shift is the number of positive pivots of the shifted matrix (Sylvester), read from a tridiagonal form.
"""

from __future__ import annotations

import numpy as np

NODES = 12
PER_INTERVAL = 16


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(diagonal, off-diagonal) of an orthogonally similar tridiagonal matrix, by reflections: inertia is unchanged."""
    a = a.copy()
    n = len(a)
    for k in range(n - 2):
        x = a[k + 1:, k].copy()
        size = np.linalg.norm(x)
        if size == 0:
            continue
        x[0] += np.copysign(size, x[0])
        x /= np.linalg.norm(x)
        a[k + 1:, k:] -= 2 * np.outer(x, x @ a[k + 1:, k:])
        a[k:, k + 1:] -= 2 * np.outer(a[k:, k + 1:] @ x, x)
    return np.diag(a).copy(), np.diag(a, -1).copy()


def count_above(form: tuple[np.ndarray, np.ndarray], shift: float) -> int:
    """Eigenvalues above ``shift``: positive pivots of the shifted tridiagonal form."""
    diagonal, off = form
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    positive, pivot = 0, 1.0
    for i in range(len(diagonal)):
        pivot = diagonal[i] - shift - (off[i - 1] * (off[i - 1] / pivot) if i else 0.0)
        if abs(pivot) < tiny:
            pivot = -tiny
        positive += pivot > 0
    return positive


def intervals(form: tuple[np.ndarray, np.ndarray], low: float, high: float, k: int, per: int = PER_INTERVAL) -> list[tuple[float, float, int]]:
    """Adjoining intervals (low, high, eigenvalues inside) from the top down that hold the k largest eigenvalues or more.

    Halved by inertia counts until each holds at most ``per``, or is too narrow to part a cluster.
    """
    width = (high - low) * 1e-13
    out, found = [], 0
    open_ = [(low, high, len(form[0]), 0)]  # as a stack, the upper half on top
    while open_ and found < k:
        a, b, above_a, above_b = open_.pop()
        inside = above_a - above_b
        if not inside:
            continue
        if inside <= per and (found + inside <= k or inside <= per // 2) or b - a <= width:
            out.append((a, b, inside))
            found += inside
            continue
        middle = (a + b) / 2
        above = count_above(form, middle)
        open_ += [(a, middle, above_a, above), (middle, b, above, above_b)]
    return out


def filtered(a: np.ndarray, block: np.ndarray, low: float, high: float, nodes: int) -> np.ndarray:
    """The block seen through the contour integral around [low, high]: Gauss-Legendre on the upper half circle, the lower one mirrors it."""
    x, w = np.polynomial.legendre.leggauss(nodes)
    centre, radius, eye = (low + high) / 2, (high - low) / 2, np.eye(len(a))
    out = np.zeros_like(block)
    for angle, weight in zip(np.pi * (x + 1) / 2, w, strict=True):
        turn = np.exp(1j * angle)
        solved = np.linalg.solve((centre + radius * turn) * eye - a, block.astype(complex))
        out += np.real(weight / 2 * radius * turn * solved)
    return out


def rayleigh_ritz(a: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ritz values and vectors of the block's column space, the directions that the filter put out left aside."""
    basis, sizes, _ = np.linalg.svd(block, full_matrices=False)
    basis = basis[:, sizes > sizes[0] * 1e-14] if sizes[0] > 0 else basis[:, :1]
    projected = basis.T @ a @ basis
    values, turn = np.linalg.eigh((projected + projected.T) / 2)
    return values, basis @ turn


def interval_pairs(a: np.ndarray, low: float, high: float, expected: int, nodes: int = NODES, rounds: int = 40, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The ``expected`` eigenpairs in (low, high]: filter and Rayleigh-Ritz in turn, until residuals are of rounding size and the count is met.

    A block that shows too few is widened. The whole space is the last of the blocks, for which the result is exact by itself.
    """
    n = len(a)
    scale = max(abs(low), abs(high), np.abs(a).sum(1).max())
    margin = max(1e-3 * (high - low), 8 * n * np.finfo(float).eps * scale)
    size = min(n, expected + expected // 2 + 4)
    random = np.random.default_rng(seed)
    while True:
        block, last = random.normal(size=(n, size)), np.inf
        for _ in range(rounds):
            seen = filtered(a, block, low - margin, high + margin, nodes) if size < n else block
            values, vectors = rayleigh_ritz(a, seen)
            inside = np.argsort(np.where((values > low - margin) & (values <= high + margin), np.abs(values - (low + high) / 2), np.inf), kind="stable")[:expected]
            ok = len(inside) == expected and bool(np.all((values[inside] > low - margin) & (values[inside] <= high + margin)))
            residual = np.linalg.norm(a @ vectors[:, inside] - vectors[:, inside] * values[inside], axis=0).max() if ok else np.inf
            if ok and (residual <= 4 * np.finfo(float).eps * scale or residual >= last / 2 and residual <= 1e-12 * scale):
                return values[inside], vectors[:, inside]
            last = residual
            block = vectors
            if block.shape[1] < size:
                block = np.column_stack([block, random.normal(size=(n, size - block.shape[1]))])
        if size == n:
            raise ArithmeticError("the inertia count is not met")
        size = min(n, 2 * size)


def leading_pairs(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues in falling order and unit eigenvectors as columns; each interval yields what its inertia counts say."""
    n = len(a)
    a = (a + a.T) / 2
    scale = np.abs(a).max()
    if not scale:
        return np.zeros(k), np.eye(n)[:, :k]
    a = a / scale
    spread = np.abs(a).sum(1) - np.abs(np.diag(a))
    low, high = (np.diag(a) - spread).min(), (np.diag(a) + spread).max()
    slack = 1e-6 * max(high - low, abs(high), abs(low))
    parts = [interval_pairs(a, x, y, count) for x, y, count in intervals(tridiagonal(a), low - slack, high + slack, k)]
    values, vectors = np.concatenate([v for v, _ in parts]), np.column_stack([u for _, u in parts])
    order = np.argsort(-values, kind="stable")
    # Clusters may lie on both sides of a bound: one last extraction makes the vectors of different intervals orthogonal.
    values, vectors = rayleigh_ritz(a, vectors[:, order])
    order = np.argsort(-values, kind="stable")[:k]
    return values[order] * scale, vectors[:, order]
