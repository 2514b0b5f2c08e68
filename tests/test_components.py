import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.operators import connect as C
from voxloom.operators import grow as G
from voxloom.operators import runs as N


def masks(seed=3):
    rng = np.random.default_rng(seed)
    snake = np.zeros((9, 7, 6), bool)
    snake[:, 3, 2] = True
    snake[8, :, 2] = True
    snake[:, 6, 2] = True
    return {0: rng.random((9, 7, 6)) < 0.35, 1: rng.random((5, 6, 7)) < 0.5, 2: snake}


@pytest.mark.parametrize("bz,by,finish", [(32, 512, 10**6), (2, 3, 10**6), (2, 3, 0), (1, 1, 0)])
def test_labels_match_flood(spark, bz, by, finish):
    ms = masks()
    got = C.components(brute.runs_frame(spark, ms).drop("bz", "by"), bz=bz, by=by, finish_rows=finish)
    want = {k: brute.labels(m) for k, m in ms.items()}
    rows = N.to_voxels(got, keep=("label",)).collect()
    assert len(rows) == sum(int(m.sum()) for m in ms.values())
    for r in rows:
        assert want[r.case_id][r.z, r.y, r.x] == r.label


def test_in_plane_labels_stay_in_their_slice(spark):
    ms = masks()
    got = N.to_voxels(C.components(brute.runs_frame(spark, ms), volumetric=False), keep=("label",)).collect()
    for r in got:
        assert r.label // (ms[r.case_id].shape[1] * ms[r.case_id].shape[2]) == r.z


def test_grow_is_independent_of_seed_order_and_inside_the_candidate(spark):
    ms = masks()
    runs = brute.runs_frame(spark, ms)
    seeds = [(k, 2, 3, 0) for k in ms] + [(k, 1, 1, 2) for k in ms] + [(2, 0, 0, 0)]
    schema = "case_id int, x int, y int, z int"
    a = brute.as_masks(N.to_voxels(C.region_grow(runs, spark.createDataFrame(seeds, schema))), ms)
    b = brute.as_masks(N.to_voxels(C.region_grow(runs, spark.createDataFrame(seeds[::-1], schema), bz=2)), ms)
    for k, m in ms.items():
        want = brute.flood(m, [(z, y, x) for c, x, y, z in seeds if c == k])
        assert (a[k] == want).all() and (b[k] == want).all() and not (a[k] & ~m).any()


def test_plane_flood_and_volume_flood_differ_on_a_pierced_box(spark):
    cube = np.zeros((5, 5, 5), bool)
    cube[:] = True
    wall = np.zeros((5, 5, 5), bool)
    wall[1:4, 1:4, 1:4] = True
    wall[2, 2, 2] = False
    wall[2, 2, 3] = False           # one hole in one slice
    air = {0: cube & ~wall}
    closed = brute.as_masks(N.to_voxels(G.interior3d(brute.runs_frame(spark, air))), air)[0]
    plane = brute.as_masks(N.to_voxels(G.interior2d(brute.runs_frame(spark, air))), air)[0]
    assert not closed.any() and not plane.any()
    wall[2, 2, 3] = True
    wall[1, 2, 2] = False           # opened along z instead
    wall[0, 2, 2] = True
    air = {0: cube & ~wall}
    closed = brute.as_masks(N.to_voxels(G.interior3d(brute.runs_frame(spark, air))), air)[0]
    plane = brute.as_masks(N.to_voxels(G.interior2d(brute.runs_frame(spark, air))), air)[0]
    assert closed.sum() == 2 and plane.sum() == 2


def test_bridge_joins_two_blobs(spark):
    two = np.zeros((4, 4, 9), bool)
    two[:, :, :3] = two[:, :, 6:] = True
    one = two.copy()
    one[2, 2, :] = True
    runs = brute.runs_frame(spark, {0: two, 1: one})
    n = {r.case_id: r.n for r in C.components(runs, bz=2, by=2).groupBy("case_id").agg(
        F.count_distinct("label").alias("n")).collect()}
    assert n == {0: 2, 1: 1}


def test_case_without_voxels_has_no_components(spark):
    assert C.components(brute.runs_frame(spark, {0: np.zeros((2, 2, 2), bool)})).count() == 0


def test_chains_take_logarithmically_many_steps(spark, monkeypatch):
    steps = []
    cut = C.cut
    monkeypatch.setattr(C, "cut", lambda df: steps.append(1) or cut(df))
    for n in (8, 64, 512):
        steps.clear()
        chain = spark.range(n).selectExpr("0 AS case_id", "id AS u", "id + 1 AS v")
        roots = C.component_roots(chain, finish_rows=0)
        assert {r.node: r.root for r in roots.collect()} == dict.fromkeys(range(n + 1), 0)
        assert len(steps) <= np.log2(n) + 6
