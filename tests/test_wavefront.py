import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.operators import wavefront as W


def volume(seed, shape=(9, 8, 7)):
    rng = np.random.default_rng(seed)
    hu = rng.integers(-700, -400, shape).astype(float)
    return hu, rng.random(shape).round(3), hu < -640, rng.random(shape) < 0.95


CASES = {k: volume(k) for k in range(4)}
PARAMS = [
    W.WavefrontParams(-600.0, -480.0, 5, 0.2, 1.5, 12, 0.5, 10, -450.0),
    W.WavefrontParams(-600.0, -480.0, 5, 0.1, 3.0, 800, 3.0, 5000, -500.0),
    W.WavefrontParams(-560.0, -480.0, 3, 0.0, 1.1, 3, 0.0, 25, -420.0),
]


@pytest.mark.parametrize("p", PARAMS)
@pytest.mark.parametrize("task_voxels", [10**6, 100, 0])
def test_layers_match_the_sequential_rules(spark, p, task_voxels):
    rows, seeds = [], [(z, 4, 3) for z in (0, 4, 8)]
    for k, (hu, vn, hard, roi) in CASES.items():
        nz, ny, nx = hu.shape
        rows += [(k, x, y, z, nx, ny, nz, float(hu[z, y, x]), float(vn[z, y, x]), bool(hard[z, y, x]), bool(roi[z, y, x]))
                 for z, y, x in np.ndindex(hu.shape)]
    vox = spark.createDataFrame(rows, "case_id int, x int, y int, z int, nx int, ny int, nz int, hu double, "
                                      "vness double, hard boolean, roi boolean")
    start = spark.createDataFrame([(k, x, y, z) for k in CASES for z, y, x in seeds], "case_id int, x int, y int, z int")
    if task_voxels == 100:
        sizes = W.eligible(vox, p, ("case_id",)).groupBy("case_id").count().agg(F.sort_array(F.collect_list("count"))).first()[0]
        task_voxels = sizes[1]      # some cases in a task, some by layers
    got = {(r.case_id, r.z, r.y, r.x): r.level for r in W.wavefront_grow(vox, start, p, task_voxels=task_voxels).collect()}
    want = {}
    for k, (hu, vn, hard, roi) in CASES.items():
        kept, level = brute.wavefront(hu, vn, hard, roi, seeds, p)
        want |= {(k, *q): level[q] for q in map(tuple, np.argwhere(kept))}
    assert got == want and len(want) > 0


def test_baseline_keeps_layers_two_to_five():
    b = W.Baseline()
    for size in (10, 20, 30, 40, 50, 60, 70):
        b.store(size)
    assert b.sizes == [70, 20, 30, 40, 50] and b.mean() == 42


def test_first_layer_has_no_baseline():
    p = W.WavefrontParams()
    assert W.Baseline().explodes(p.leak_base + 1, p) and not W.Baseline().explodes(p.leak_base, p)
