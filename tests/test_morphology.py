import brute
import numpy as np
import pytest

from voxloom.operators import grow as G
from voxloom.operators import runs as N


def masks():
    rng = np.random.default_rng(5)
    return {0: rng.random((6, 7, 8)) < 0.06, 1: rng.random((4, 4, 5)) < 0.5, 2: np.ones((3, 3, 3), bool)}


def arrays(spark, runs, ms):
    return brute.as_masks(N.to_voxels(runs), ms)


@pytest.mark.parametrize("m,slab", [(1, 32), (2, 32), (1, 2), (2, 1)])
def test_dilate_erode_close(spark, m, slab):
    ms = masks()
    runs = brute.runs_frame(spark, ms)
    wide, slim, shut = (arrays(spark, f(runs, m, slab=slab), ms) for f in (N.dilate, N.erode, N.close))
    again = arrays(spark, N.close(N.close(runs, m), m), ms)
    for k, mask in ms.items():
        assert (wide[k] == brute.box(mask, m)).all() and not (mask & ~wide[k]).any()
        assert (slim[k] == ~brute.box(~mask, m)).all()
        assert (shut[k] == ~brute.box(~brute.box(mask, m), m)).all()
        assert (again[k] == shut[k]).all()


def test_set_algebra(spark):
    ms = masks()
    other = {k: np.roll(m, 1, axis=2) for k, m in ms.items()}
    a, b = brute.runs_frame(spark, ms), brute.runs_frame(spark, other)
    both, either = arrays(spark, G.intersect(a, b), ms), arrays(spark, G.union(a, b), ms)
    for k in ms:
        assert (both[k] == (ms[k] & other[k])).all() and (either[k] == (ms[k] | other[k])).all()


def test_within_marks_members(spark):
    ms = masks()
    marked = G.within(brute.voxel_frame(spark, {k: m * 1.0 for k, m in ms.items()}), brute.runs_frame(spark, ms), "in")
    rows = marked.collect()
    assert len(rows) == sum(m.size for m in ms.values())
    assert all(bool(r["in"]) == (r["hu"] > 0) for r in rows)
