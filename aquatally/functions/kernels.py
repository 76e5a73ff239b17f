"""Numeric helpers on a stack of days, for the two steps SQL expressions cannot state."""

from __future__ import annotations

import sys

import numpy as np
from pyspark.cloudpickle import register_pickle_by_value

# Task code travels with the job, so executors need no copy of the package.
register_pickle_by_value(sys.modules[__name__])


def polynomial_band(hours: int, width: int, order: int = 3) -> tuple[list[int], list[list[float]]]:
    """Moving polynomial fit as weights: for each hour the window start and its weights.

    Inside the day the fit is evaluated at the window centre, near its ends in the
    first or last full window.
    """
    x = np.arange(width) - width // 2
    fit = np.linalg.pinv(np.vander(x, order + 1, increasing=True).astype(float))
    starts, rows = [], []
    for hour in range(hours):
        start = min(max(hour - width // 2, 0), hours - width)
        at = float(hour - start - width // 2)
        starts.append(start)
        rows.append([float(w) for w in at ** np.arange(order + 1) @ fit])
    return starts, rows


def truncated(matrix: np.ndarray, rank: int) -> np.ndarray:
    """Best approximation of the given rank."""
    u, s, vt = np.linalg.svd(matrix, full_matrices=False)
    return (u[:, :rank] * s[:rank]) @ vt[:rank]


def refine_low_rank(
    start: np.ndarray, known: np.ndarray, n_components: int, max_iterations: int, tolerance: float
) -> np.ndarray:
    """Repeatedly replace the unknown cells by their low-rank approximation.

    Stops when the relative change of the matrix falls below the tolerance.  A matrix
    of one day, or with cells nothing could fill, is returned as it is.
    """
    rank = min(n_components, min(start.shape) - 1)
    if rank < 1 or np.isnan(start).any():
        return start
    current = start.copy()
    previous = None
    for _ in range(max_iterations):
        try:
            approximation = truncated(current, rank)
        except np.linalg.LinAlgError:
            break
        current = np.where(known, current, approximation)
        if previous is not None:
            size = np.linalg.norm(current)
            if size == 0 or np.linalg.norm(current - previous) / size < tolerance:
                break
        previous = current
    return current


def leading_projection(gram: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Projection on the leading eigenvectors of each Gram matrix of a stack, ``rank`` for each.

    ``A @ projection`` is the truncated SVD of A when gram is ``A.T @ A``.
    """
    _, vectors = np.linalg.eigh(gram)
    width = gram.shape[-1]
    kept = np.arange(width) >= width - np.asarray(rank)[:, None]
    leading = vectors * kept[:, None, :]
    return leading @ np.swapaxes(leading, -1, -2)


def square(upper: np.ndarray, n: int) -> np.ndarray:
    """Symmetric matrices from their upper triangles, one per row."""
    out = np.zeros((len(upper), n, n))
    i, j = np.triu_indices(n)
    out[:, i, j] = upper
    out[:, j, i] = upper
    return out


def roughness_basis(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of the curvature integral of a natural cubic spline with unit steps."""
    q = np.zeros((n, n - 2))
    for k in range(n - 2):
        q[k : k + 3, k] = (1.0, -2.0, 1.0)
    r = np.diag(np.full(n - 2, 2.0 / 3.0))
    r += np.diag(np.full(n - 3, 1.0 / 6.0), 1) + np.diag(np.full(n - 3, 1.0 / 6.0), -1)
    values, vectors = np.linalg.eigh(q @ np.linalg.solve(r, q.T))
    values[:2] = 0.0  # constants and straight lines bend nowhere
    return values, vectors


def smooth_spline(days: np.ndarray, allowed: float) -> np.ndarray:
    """Least-curvature spline of each row with a squared residual of at most ``allowed``."""
    values, vectors = roughness_basis(days.shape[1])
    parts = days @ vectors
    bend = parts[:, 2:] ** 2

    def residual(penalty: np.ndarray) -> np.ndarray:
        pull = penalty[:, None] * values[None, 2:]
        return (bend * (pull / (1.0 + pull)) ** 2).sum(axis=1)

    low = np.full(len(days), -30.0)
    high = np.full(len(days), 30.0)
    for _ in range(80):
        middle = (low + high) / 2
        too_far = residual(np.exp(middle)) > allowed
        high = np.where(too_far, middle, high)
        low = np.where(too_far, low, middle)
    shrink = 1.0 / (1.0 + np.exp(low)[:, None] * values[None, :])
    shrink[bend.sum(axis=1) <= allowed, 2:] = 0.0
    return (parts * shrink) @ vectors.T
