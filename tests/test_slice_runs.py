"""Runs cut where slices lie: against masks, over pieces, widths, nulls, sweeps; no exchange in the plan."""

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.operators import connect as C
from voxloom.operators import runs as N


def volumes():
    rng = np.random.default_rng(8)
    return {k: np.round(rng.normal(0, 40, shape)) for k, shape in enumerate([(5, 4, 7), (3, 6, 7), (4, 5, 3), (2, 1, 1)])}


@pytest.mark.parametrize("piece", [1, 40, 1 << 22])
def test_slices_of_any_width_become_their_runs(spark, piece):
    vs = volumes()
    runs = N.slice_runs(brute.slices_frame(spark, vs), N.cells(lambda v: v <= 5, "data"), piece=piece)
    got = brute.as_masks(N.to_voxels(runs), vs)
    assert all((got[k] == (v <= 5)).all() for k, v in vs.items())
    lines = {(r.case_id, r.z, r.y): [] for r in runs.collect()}
    for r in runs.collect():
        lines[r.case_id, r.z, r.y].append((r.x0, r.x1))
    for spans in lines.values():
        spans.sort()
        assert all(b[0] > a[1] + 1 for a, b in zip(spans, spans[1:]))      # maximal


def test_cells_know_their_place(spark):
    vs = volumes()
    runs = N.slice_runs(brute.slices_frame(spark, vs), N.cells(lambda v, x, y: (v <= 5) & (x != 1) & (y > 0), "data"))
    got = brute.as_masks(N.to_voxels(runs), vs)
    for k, v in vs.items():
        _, y, x = np.indices(v.shape)
        assert (got[k] == ((v <= 5) & (x != 1) & (y > 0))).all()


def test_sweep_equals_one_mask_an_entry(spark):
    vs = volumes()
    got = N.sweep_runs(brute.slices_frame(spark, vs), F.col("data"), {-30.0: -30.0, 0.0: 0.0, 30.0: 30.0}, "thr")
    for t in (-30.0, 0.0, 30.0):
        at = brute.as_masks(N.to_voxels(got.where(F.col("thr") == t)), vs)
        assert all((at[k] == (v <= t)).all() for k, v in vs.items())


def test_nulls_set_nothing_and_short_slices_are_errors(spark):
    schema = "case_id int, z int, nx int, ny int, nz int, m array<boolean>"
    rows = [(1, 0, 2, 2, 3, [True, None, None, True]), (1, 1, 2, 2, 3, None), (None, 2, 2, 2, 3, [True] * 4)]
    got = N.slice_runs(spark.createDataFrame(rows, schema), F.col("m")).collect()
    assert {(r.case_id, r.z, r.y, r.x0, r.x1) for r in got} == {
        (1, 0, 0, 0, 0), (1, 0, 1, 1, 1), (None, 2, 0, 0, 1), (None, 2, 1, 0, 1)}
    assert N.slice_runs(spark.createDataFrame([], schema), F.col("m")).count() == 0
    with pytest.raises(Exception, match="does not fill its grid"):
        N.slice_runs(spark.createDataFrame([(1, 0, 2, 2, 1, [True])], schema), F.col("m")).collect()


def test_painted_masks_share_one_array(spark):
    vs = volumes()
    low, high = ({k: v <= t for k, v in vs.items()} for t in (-20, 20))
    marks = N.painted([brute.runs_frame(spark, low), brute.runs_frame(spark, high)])
    seen = {(r.case_id, r.z): np.array(r.marks) for r in marks.collect()}
    for k, v in vs.items():
        for z in range(len(v)):
            want = (low[k][z] + 2 * high[k][z]).ravel()
            assert (seen.get((k, z), np.zeros(want.size)) == want).all()


def test_voxels_are_not_exchanged(spark):
    slices = brute.slices_frame(spark, volumes())
    runs = N.slice_runs(slices, N.cells(lambda v: v <= 5, "data"))
    plan = runs._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan
    assert C.components(runs).count() == runs.count()
