import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.functions.voxel import gaussian_taps
from voxloom.operators import resample as R
from voxloom.operators import stencils as K
from voxloom.operators import tiles as T
from voxloom.sources.tables import number_within, to_voxels


def cube(frame, value, shape):
    out = np.full(shape, np.nan)
    for r in frame.collect():
        out[r.z, r.y, r.x] = r[value]
    return out


def smooth(v, taps):
    r = len(taps) // 2
    for axis in (2, 1, 0):
        n = v.shape[axis]
        v = sum(w * np.take(v, np.clip(np.arange(n) + k - r, 0, n - 1), axis) for k, w in enumerate(taps))
    return v


def test_gaussian_self_check(spark):
    n = 24
    field = np.sin(0.05 * np.arange(n ** 3)).reshape(n, n, n)
    got = cube(to_voxels(K.gaussian(brute.slices_frame(spark, {0: field}), 2, 1.0, slab=5), "v", "smoothed"), "v", field.shape)
    want = smooth(field, gaussian_taps(2, 1.0))
    assert np.abs(got - want).max() / np.abs(want).max() < 1e-4


@pytest.mark.parametrize("slab", [3, 4, 64])
def test_slab_depth_does_not_matter(spark, slab):
    rng = np.random.default_rng(1)
    v = rng.integers(-700, -300, (11, 6, 5)).astype(float)
    s = brute.slices_frame(spark, {0: v})
    vness = cube(K.vesselness(s, slab=slab, sigmas=(1.0, 1.5)), "vness", v.shape)
    base = cube(K.vesselness(s, slab=11, sigmas=(1.0, 1.5)), "vness", v.shape)
    assert np.allclose(vness, base, atol=1e-12) and vness.max() > 0 and vness.max() <= 1
    grad = cube(K.gradient_magnitude(s, slab=slab), "grad", v.shape)
    p = np.pad(v, 1, mode="edge")
    c = slice(1, -1)
    want = 0.5 * np.sqrt((p[c, c, 2:] - p[c, c, :-2]) ** 2 + (p[c, 2:, c] - p[c, :-2, c]) ** 2 + (p[2:, c, c] - p[:-2, c, c]) ** 2)
    assert np.allclose(grad, want)
    pooled = cube(to_voxels(R.downsample2(s, slab=4), "v"), "v", (5, 3, 2))
    assert np.allclose(pooled, v[:10, :6, :4].reshape(5, 2, 3, 2, 2, 2).mean((1, 3, 5)))


def test_taps_of_any_radius_are_normalised():
    for radius, sigma in ((1, 0.3), (16, 5.0), (40, 12.0)):
        assert len(gaussian_taps(radius, sigma)) == 2 * radius + 1 and abs(sum(gaussian_taps(radius, sigma)) - 1) < 1e-12
    with pytest.raises(ValueError):
        gaussian_taps(0, 1.0)


def test_wide_kernels_are_not_cut(spark):
    rng = np.random.default_rng(4)
    v = rng.integers(-700, -300, (30, 9, 8)).astype(float)
    taps = K.scale_kernels((8.0,), False)["s0"][0]
    assert len(taps) == 2 * 24 + 1
    got = cube(to_voxels(K.smooth(brute.slices_frame(spark, {0: v}), {"smoothed": [taps]}, slab=7), "v", "smoothed"), "v", v.shape)
    assert np.allclose(got, smooth(v, taps))


@pytest.mark.parametrize("n,patch,stride,want", [
    (100, 128, 96, [0]), (128, 128, 96, [0]), (300, 128, 96, [0, 96, 172]), (320, 128, 96, [0, 96, 192])])
def test_tile_starts(spark, n, patch, stride, want):
    assert spark.range(1).select(T.tile_starts(F.lit(n), patch, stride).alias("s")).first().s == want


def test_tiles_of_a_position_on_an_axis_of_any_length(spark):
    # All starts of the longer axis would not fit an array.
    n = 2 ** 31 - 1
    ends = spark.createDataFrame([(n, 0), (n, 5), (n, n - 1)], "n int, at int")
    got = [r.s for r in ends.select("at", T.holding(F.col("n"), F.col("at"), 5, 1).alias("s")).orderBy("at").collect()]
    assert got == [[0], [1, 2, 3, 4, 5], [n - 5]]


@pytest.mark.parametrize("patch,stride", [(5, 3), (4, 4), (3, 5), (1, 1), (7, 2)])
def test_tiles_of_a_position_are_the_starts_around_it(spark, patch, stride):
    cells = spark.range(1, 25).selectExpr("cast(id as int) as n").selectExpr("n", "explode(sequence(-2, n + 2)) as at")
    rows = cells.select("at", T.tile_starts(F.col("n"), patch, stride).alias("all"),
                        T.holding(F.col("n"), F.col("at"), patch, stride).alias("s")).collect()
    assert len(rows) > 300 and all(r.s == [s for s in r.all if s <= r.at < s + patch] for r in rows)


def test_constant_model_gives_a_constant_map(spark):
    v = np.arange(7 * 9 * 10, dtype=float).reshape(7, 9, 10)
    s = brute.slices_frame(spark, {0: v, 1: v[:3]})

    def constant(tensor):
        return np.stack([np.zeros(tensor[:, 0].shape), np.full(tensor[:, 0].shape, np.log(3.0))], axis=1)

    tiles = to_voxels(T.score_tiles(s, constant, 4, 3), "p")
    plane = to_voxels(T.score_slices(s, constant, size=16, batch=2), "p")
    for out in (tiles, plane):
        rows = out.collect()
        assert len(rows) == v.size + v[:3].size and all(abs(r.p - 0.75) < 1e-6 for r in rows)


@pytest.mark.parametrize("batch", [1, 3, 100])
def test_tiles_share_model_calls(spark, batch):
    rng = np.random.default_rng(1)
    s = brute.slices_frame(spark, {k: rng.integers(-900, 500, (5 + k, 6, 7)).astype(float) for k in range(3)})

    def ramp(tensor):
        assert 1 <= len(tensor) <= batch
        # A model that fits no tile alone would show here: the answer depends on the tile's own mean.
        own = tensor[:, 0] + tensor[:, 0].mean(axis=(1, 2, 3), keepdims=True)
        return np.stack([np.zeros_like(own), own * 4 - 2], axis=1)

    def scored(n):
        return {(r.case_id, r.z): r.data for r in T.score_tiles(s, ramp, 4, 3, batch=n).collect()}
    got, want = scored(batch), scored(1)
    assert got.keys() == want.keys() and len(got) == 18 and all(np.allclose(got[k], want[k]) for k in want)


def test_numbering_is_chunk_independent(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7).alias("k"))
    a = number_within(df, "g", "k", "pos", "n", chunk=10).collect()
    assert sorted((r.g, r.k, r.pos) for r in a) == sorted((i % 3, i * 7, i // 3) for i in range(1000))
    assert {r.n for r in a} == {333, 334}


def test_trilinear_identity_and_linearity(spark):
    z, y, x = np.meshgrid(np.arange(5), np.arange(6), np.arange(7), indexing="ij")
    v = (3.0 * x + 5 * y - 2 * z).astype(float)
    s = brute.slices_frame(spark, {0: v})
    same = cube(R.trilinear(s, (F.lit(7), F.lit(6), F.lit(5)), slab=2), "value", v.shape)
    assert np.allclose(same, v)
    fine = cube(R.trilinear(s, (F.lit(16), F.lit(16), F.lit(16)), slab=2), "value", (16, 16, 16))
    zz, yy, xx = np.meshgrid(np.linspace(0, 4, 16), np.linspace(0, 5, 16), np.linspace(0, 6, 16), indexing="ij")
    assert np.allclose(fine, 3 * xx + 5 * yy - 2 * zz)
