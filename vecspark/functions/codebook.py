"""Scalar codebooks for coordinates of random unit vectors.

A coordinate of a uniform point on the sphere in d dimensions has the density g(t) ~ (1 - t^2)^((d - 3) / 2).  A codebook
holds the Lloyd-Max centroids of that density for 2^bits cells.  Each cell's integrals are Simpson sums over the cell
itself, so that cells far out keep their relative precision however little mass they have.
"""

from __future__ import annotations

from functools import lru_cache
from math import lgamma, log, pi

import numpy as np

#: The solver's limits and the intervals of a cell, which centroids depend on in their last digits. The boundaries that go with the centroids are those of the last step's start.
STEPS, TOLERANCE, EMPTY = 200, 1e-10, 1e-30
INTERVALS = 10_000


def density(t: np.ndarray, dim: int) -> np.ndarray:
    inside = np.abs(t) < 1
    scale = lgamma(dim / 2) - 0.5 * log(pi) - lgamma((dim - 1) / 2)
    safe = np.where(inside, t, 0.0)
    return np.where(inside, np.exp(scale + 0.5 * (dim - 3) * np.log1p(-safe * safe)), 0.0)


def moments(edges: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The integrals of g, t g and t^2 g between neighbouring edges."""
    step = (edges[1:] - edges[:-1]) / INTERVALS
    weight = np.full(INTERVALS + 1, 2.0)
    weight[1::2] = 4.0
    weight[[0, -1]] = 1.0
    t = edges[:-1, None] + step[:, None] * np.arange(INTERVALS + 1)
    w = density(t, dim) * weight * step[:, None] / 3
    return w.sum(axis=1), (w * t).sum(axis=1), (w * t * t).sum(axis=1)


@lru_cache(maxsize=256)
def codebook(dim: int, bits: int) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """(centroids, boundaries): 2^bits and one less, as float32 values."""
    if dim < 2 or not 1 <= bits <= 8:
        raise ValueError(f"no codebook for {dim} dimensions at {bits} bits")
    cells = 1 << bits
    centroids = -1 + (2 * np.arange(cells) + 1) / cells
    boundaries = np.zeros(0)
    for _ in range(STEPS):
        boundaries = (centroids[1:] + centroids[:-1]) / 2
        edges = np.concatenate(([-1.0], boundaries, [1.0]))
        own, first, _ = moments(edges, dim)
        fresh = np.where(own > EMPTY, first / np.maximum(own, EMPTY), (edges[1:] + edges[:-1]) / 2)
        moved = np.abs(fresh - centroids).max()
        centroids = fresh
        if moved < TOLERANCE:
            break
    as_floats = lambda x: tuple(np.float32(x).astype(float).tolist())
    return as_floats(centroids), as_floats(boundaries)


def expected_error(dim: int, bits: int) -> float:
    """The mean squared error of a quantized unit vector: dim times that of a coordinate."""
    centroids, boundaries = map(np.array, codebook(dim, bits))
    mass, first, second = moments(np.concatenate(([-1.0], boundaries, [1.0])), dim)
    return float(dim * (second - 2 * centroids * first + centroids**2 * mass).sum())
