import numpy as np
import pytest

from vecspark.functions import codes
from vecspark.functions.codebook import codebook, expected_error
from vecspark.functions.spec import ProductSpec, QuantizerSpec, blocks_of, derived_seed, hadamard, packed_size
from vecspark.sources import blobs


def unit_vectors(n, dim, seed=1):
    x = np.random.default_rng(seed).standard_normal((n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_codebook_of_four_dimensions():
    centroids, boundaries = codebook(4, 2)
    assert np.allclose(centroids, [-0.67441684, -0.21944587, 0.21944587, 0.67441684], atol=1e-7)
    assert np.allclose(boundaries, [-0.44693136, 0, 0.44693136], atol=1e-6)


@pytest.mark.parametrize("bits,error", [(1, 0.36), (2, 0.117), (3, 0.03), (4, 0.009)])
def test_expected_error(bits, error):
    assert abs(expected_error(384, bits) - error) < 0.2 * error


@pytest.mark.parametrize("dim", [2, 3, 64, 127, 130, 384])
@pytest.mark.parametrize("kind", ["hadamard", "dense"])
def test_rotation_keeps_lengths_and_turns_back(dim, kind):
    spec, x = QuantizerSpec(dim, 2, 7, kind), unit_vectors(20, dim)
    y = spec.rotate(x)
    assert np.allclose(np.linalg.norm(y, axis=1), 1, atol=1e-5)
    assert np.allclose(spec.unrotate(y), x, atol=1e-5)
    assert np.allclose(x @ spec.dense.T, y, atol=1e-6)


def test_blocks_and_transform():
    assert blocks_of(384) == [(0, 256), (256, 128)] and blocks_of(130) == [(0, 128), (128, 2)]
    signs = [[(-1) ** bin(i & j).count("1") / 8**0.5 for j in range(8)] for i in range(8)]
    assert np.allclose(hadamard(np.eye(8)), signs)


@pytest.mark.parametrize("count,bits,size", [(8, 1, 1), (9, 1, 2), (8, 2, 2), (8, 4, 4), (10, 3, 4), (384, 2, 96)])
def test_packed_size(count, bits, size):
    assert packed_size(count, bits) == size


@pytest.mark.parametrize("bits", range(1, 9))
def test_pack_and_unpack(bits):
    cells = np.random.default_rng(bits).integers(0, 1 << bits, (7, 13))
    packed = codes.pack(cells, bits)
    assert packed.shape == (7, packed_size(13, bits)) and (codes.unpack(packed, 13, bits) == cells).all()


def test_pack_order():
    assert codes.pack(np.array([[0, 1, 2, 3, 4, 5, 6, 7, 7, 0]]), 3).tobytes() == (sum(v << 3 * i for i, v in enumerate([0, 1, 2, 3, 4, 5, 6, 7, 7, 0]))).to_bytes(4, "little")


@pytest.mark.parametrize("bits", [1, 2, 3, 4])
def test_error_of_codes(bits):
    spec, x = QuantizerSpec(384, bits), unit_vectors(300, 384)
    cells, _ = codes.indices(x, spec)
    error = ((codes.reconstruct(cells, spec) - x) ** 2).sum(axis=1).mean()
    assert abs(error - expected_error(384, bits)) < 0.1 * expected_error(384, bits)


def test_product_code_estimates_without_bias():
    spec, x, y = ProductSpec(128, 3), unit_vectors(2000, 128, 2), unit_vectors(2000, 128, 3)
    parts = codes.encode_product(x, spec)
    got = np.array([codes.product_scores(*(p[i : i + 1] for p in parts), y[i : i + 1], spec)[0, 0] for i in range(200)])
    exact = (x[:200] * y[:200]).sum(axis=1)
    assert abs((got - exact).mean()) < 0.02 and np.corrcoef(got, (x[:200] * y[:200]).sum(axis=1))[0, 1] > 0.7


def test_product_code_has_no_norm():
    spec, x, y = ProductSpec(16, 3), unit_vectors(4, 16), unit_vectors(3, 16, 9)
    same = codes.product_scores(*codes.encode_product(x, spec), y, spec)
    assert np.allclose(same, codes.product_scores(*codes.encode_product(5 * x, spec), y, spec), atol=1e-6)


def test_zero_vector():
    spec = QuantizerSpec(8, 2)
    cells, norm = codes.indices(np.zeros((1, 8)), spec)
    assert norm[0] == 0 and (codes.scores(cells, norm, np.ones((1, 8)), spec) == 0).all()


def test_index_out_of_range():
    with pytest.raises(ValueError):
        codes.reconstruct(np.array([[0, 4]]), QuantizerSpec(2, 2))


def test_uniform():
    assert np.allclose(codes.uniform(np.array([[3.0, 4.0], [0, 0]]), 1), [[5, 5], [0, 0]])


@pytest.mark.parametrize("bad", [dict(dim=1, bits=2), dict(dim=4, bits=0), dict(dim=4, bits=9), dict(dim=4, bits=2, rotation="x")])
def test_bad_specs(bad):
    with pytest.raises(ValueError):
        QuantizerSpec(**bad)


def test_derived_seed_is_signed():
    assert derived_seed(42, 0x6B765F76616C7565) == 42 ^ 0x6B765F76616C7565
    assert -(1 << 63) <= derived_seed(-1, 0x6B765F76616C7565) < 1 << 63


#: Blobs for 4 dimensions, seed 42, that other programs made.
COMPACT = bytes.fromhex("040000000000000002000000000000002a0000000000000002")
PORTABLE = bytes.fromhex(
    "545150420101020004000000020000002a00000000000000100000000400000003000000000000000000003f0000003f0000003f000000bf000000bf0000003f0000003f0000003f0000003f000000bf"
    "0000003f0000003f0000003f0000003f000000bf0000003f95a62cbf6bb660be6bb6603e95a62c3f30d4e4be0000a8a530d4e43e"
)


def test_fixed_blobs_are_read_and_written_alike():
    spec = blobs.from_portable(PORTABLE)
    assert (spec.dim, spec.bits, spec.seed, spec.rotation) == (4, 2, 42, "hadamard")
    assert np.allclose(spec.dense @ spec.dense.T, np.eye(4)) and blobs.portable(spec) == PORTABLE
    assert np.allclose(spec.centroids, codebook(4, 2)[0], atol=1e-7)
    assert blobs.compact(blobs.from_compact(COMPACT)) == COMPACT
    assert blobs.from_compact(COMPACT[:24]).rotation == "dense" and blobs.from_compact(COMPACT + b"x").dim == 4


@pytest.mark.parametrize("data", [b"", PORTABLE[:-1], PORTABLE + b"x", b"XXXX" + PORTABLE[4:]])
def test_broken_portable(data):
    with pytest.raises(ValueError):
        blobs.from_portable(data)


def test_product_portable_round_trip():
    spec = ProductSpec(16, 3, 5)
    again, x, y = blobs.from_portable(blobs.portable(spec)), unit_vectors(5, 16), unit_vectors(2, 16, 4)
    assert np.allclose(codes.product_scores(*codes.encode_product(x, spec), y, spec), codes.product_scores(*codes.encode_product(x, again), y, again), atol=1e-5)


def test_wire():
    data = blobs.wire(b"\x01\x02", 1.5, 8, 2)
    assert len(data) == 24 and blobs.from_wire(data) == {"dim": 8, "bits": 2, "norm": 1.5, "packed": b"\x01\x02", "signs": b""}
    for bad in (data[:10], data + b"x", b"ZZ" + data[2:]):
        with pytest.raises(ValueError):
            blobs.from_wire(bad)
