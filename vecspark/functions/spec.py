"""Quantizer specifications: what a code means. Small, immutable, made on the driver, broadcast or put into SQL as literals."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import cached_property, lru_cache

import numpy as np

from .codebook import codebook

#: How seeds of parts follow from a seed.
RESIDUAL_SEED = 0x5DEECE66D
VALUE_SEED = 0x6B765F76616C7565
SEED_STEP = 1315423911
_SIGNED = 1 << 63


def derived_seed(seed: int, with_: int) -> int:
    """seed xor a constant, as a signed 64-bit integer."""
    return ((seed ^ with_) + _SIGNED) % (2 * _SIGNED) - _SIGNED


def head_seed(seed: int, head: int) -> int:
    return derived_seed(seed, (head + 1) * SEED_STEP)


def blocks_of(dim: int) -> list[tuple[int, int]]:
    """(offset, size) of powers of two that add up to dim, the largest first."""
    out, at = [], 0
    for bit in reversed(range(dim.bit_length())):
        if dim >> bit & 1:
            out.append((at, 1 << bit))
            at += 1 << bit
    return out


@lru_cache
def _hadamard_matrix(n: int) -> np.ndarray:
    h = np.ones((1, 1))
    while len(h) < n:
        h = np.block([[h, h], [h, -h]])
    return h


def hadamard(x: np.ndarray) -> np.ndarray:
    """The normalised Walsh-Hadamard transform of each row; a power of two of columns.

    The matrix of a b columns is the product of those of a and of b over the two halves of the index, so each step is one matrix
    product with a matrix of 32 at the most.
    """
    rows, n = x.shape
    out, left, done = x, n, 1
    while left > 1:
        size = min(32, left)
        left //= size
        # (rows, left, size, done): the middle part of the index is transformed, then moved to the end.
        parts = out.reshape(rows * left, size, done)
        if done > 1:
            parts = parts.swapaxes(1, 2)
        parts = parts.reshape(-1, size) @ _hadamard_matrix(size)
        out = (parts.reshape(rows * left, done, size).swapaxes(1, 2) if done > 1 else parts).reshape(rows, n)
        done *= size
    return out / np.sqrt(n)


@dataclass(frozen=True)
class QuantizerSpec:
    """dim coordinates at `bits` bits each after a rotation, 'hadamard' or 'dense'. A dense matrix can be given."""

    dim: int
    bits: int
    seed: int = 42
    rotation: str = "hadamard"
    matrix: np.ndarray | None = field(default=None, compare=False, repr=False)
    levels: tuple[tuple[float, ...], tuple[float, ...]] | None = field(default=None, compare=False, repr=False)

    def __post_init__(self):
        if self.dim < 2:
            raise ValueError(f"dim must be 2 or more, not {self.dim}")
        if not 1 <= self.bits <= 8:
            raise ValueError(f"bits must be from 1 to 8, not {self.bits}")
        if self.rotation not in ("hadamard", "dense"):
            raise ValueError(f"unknown rotation {self.rotation!r}")

    @property
    def centroids(self) -> np.ndarray:
        return np.array((self.levels or codebook(self.dim, self.bits))[0])

    @property
    def boundaries(self) -> np.ndarray:
        return np.array((self.levels or codebook(self.dim, self.bits))[1])

    def solved(self) -> QuantizerSpec:
        """The same with its codebook inside, so that tasks don't solve it again."""
        return self if self.levels else replace(self, levels=codebook(self.dim, self.bits))

    @property
    def code_bytes(self) -> int:
        return packed_size(self.dim, self.bits)

    @cached_property
    def parts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order, signs before, signs after) of the Hadamard rotation."""
        rng = np.random.Generator(np.random.PCG64(self.seed % (2 * _SIGNED)))
        order = rng.permutation(self.dim)
        before, after = rng.integers(0, 2, (2, self.dim)) * 2.0 - 1.0
        return order, before, after

    @cached_property
    def dense(self) -> np.ndarray:
        """The rotation as a matrix."""
        if self.matrix is not None:
            return np.asarray(self.matrix, float)
        if self.rotation == "hadamard":
            return self.rotate(np.eye(self.dim)).T.copy()
        rng = np.random.Generator(np.random.PCG64(self.seed % (2 * _SIGNED)))
        q, r = np.linalg.qr(rng.standard_normal((self.dim, self.dim)))
        return (q * np.sign(np.diag(r))).astype(np.float32).astype(float)

    def rotate(self, x: np.ndarray) -> np.ndarray:
        """Each row rotated."""
        if self.rotation == "dense" or self.matrix is not None:
            return x @ self.dense.T
        order, before, after = self.parts
        return self._mixed(x, order, before, after)

    def unrotate(self, y: np.ndarray) -> np.ndarray:
        if self.rotation == "dense" or self.matrix is not None:
            return y @ self.dense
        order, before, after = self.parts
        return self._mixed(y, order, after, before)

    def _mixed(self, x, order, first, then) -> np.ndarray:
        work, out = x[:, order] * first, np.empty(x.shape)
        for at, size in blocks_of(self.dim):
            work[:, at : at + size] = hadamard(work[:, at : at + size])
        out[:, order] = work * then
        return out


def exported(spec: QuantizerSpec) -> dict:
    """All that a plain code's meaning depends on, as lists and numbers: what another program needs to read codes."""
    out = {"dim": spec.dim, "bits": spec.bits, "seed": spec.seed, "rotation": spec.rotation, "centroids": spec.centroids.tolist(), "boundaries": spec.boundaries.tolist()}
    if spec.rotation == "dense" or spec.matrix is not None:
        return out | {"dense": spec.dense.ravel().tolist()}
    order, before, after = spec.parts
    return out | {"order": order.tolist(), "before": before.tolist(), "after": after.tolist(), "blocks": [{"offset": a, "size": n} for a, n in blocks_of(spec.dim)]}


def imported(parts: dict) -> QuantizerSpec:
    """The spec of exported() parts; its rotation is a matrix, whatever made it."""
    dim = parts["dim"]
    if "dense" in parts:
        matrix = np.array(parts["dense"]).reshape(dim, dim)
    else:
        order, before, after = (np.array(parts[x]) for x in ("order", "before", "after"))
        work, matrix = np.eye(dim)[:, order] * before, np.empty((dim, dim))
        for b in parts["blocks"]:
            own = slice(b["offset"], b["offset"] + b["size"])
            work[:, own] = hadamard(work[:, own])
        matrix[:, order] = work * after
        matrix = matrix.T.copy()
    return QuantizerSpec(dim, parts["bits"], parts["seed"], parts["rotation"], matrix, (tuple(parts["centroids"]), tuple(parts["boundaries"])))


@dataclass(frozen=True)
class ProductSpec:
    """An inner-product code of `bits` bits: a quantizer at one bit less, and a sign sketch of what it leaves."""

    dim: int
    bits: int
    seed: int = 42
    rotation: str = "hadamard"
    given: tuple = field(default=(), compare=False, repr=False)

    def __post_init__(self):
        if not 2 <= self.bits <= 8:
            raise ValueError(f"bits must be from 2 to 8, not {self.bits}")

    @cached_property
    def base(self) -> QuantizerSpec:
        return self.given[0] if self.given else QuantizerSpec(self.dim, self.bits - 1, self.seed, self.rotation)

    def solved(self) -> ProductSpec:
        return self if self.given else replace(self, given=(self.base.solved(), self.projection))

    @cached_property
    def projection(self) -> np.ndarray:
        if self.given:
            return np.asarray(self.given[1], float)
        rng = np.random.Generator(np.random.PCG64(derived_seed(self.seed, RESIDUAL_SEED) % (2 * _SIGNED)))
        return rng.standard_normal((self.dim, self.dim)).astype(np.float32).astype(float)

    @property
    def scale(self) -> float:
        return float(np.sqrt(np.pi / 2) / self.dim)


def packed_size(count: int, bits: int) -> int:
    return (count * bits + 7) // 8
