"""Early stop, time a voxel, throughput and the error verdict against plain Python."""

import numpy as np
import pytest

from voxloom.operators import case_stats as S


def plain_stop(scores, patience, margin, start=0.0):
    best, at, since = start, None, 0
    for i, v in enumerate(scores):
        if v is not None and v > best + margin:
            best, at, since = v, i, 0
        else:
            since += 1
            if since >= patience:
                return best, at, i
    return best, at, None


@pytest.mark.parametrize("patience,margin", [(1, 0.0), (3, 0.02), (5, 1e-4), (40, 0.1)])
def test_early_stop_is_the_sequential_rule(spark, patience, margin):
    rng = np.random.default_rng(2)
    series = {f"r{k}": [float(v) for v in rng.random(k * 7 + 1) * np.linspace(0.3, 1, k * 7 + 1)] for k in range(8)}
    series["up"] = [i / 100 for i in range(60)]
    series["flat"] = [0.5] * 30
    series["low"] = [-1.0] * 4
    series["gaps"] = [None, 0.3, None, None, 0.31, None, None, None, None, None, None, 0.9]
    series["none"] = [None, None]
    rows = [(k, i * 3, v) for k, vs in series.items() for i, v in enumerate(vs)]
    got = S.early_stop(spark.createDataFrame(rows, "series string, epoch int, v double"), "epoch", "v", "series",
                       patience, margin, width=10).collect()
    assert {r.series for r in got} == set(series)
    for r in got:
        best, at, stop = plain_stop(series[r.series], patience, margin)
        assert (r.epochs, r.best) == (len(series[r.series]), best)
        assert (r.best_at, r.stop_at) == (None if at is None else at * 3, None if stop is None else stop * 3)


def test_early_stop_of_nothing(spark):
    assert S.early_stop(spark.createDataFrame([], "series string, epoch int, v double"), "epoch", "v", "series", 3).count() == 0


def test_voxel_cost_uses_only_cases_with_a_size(spark):
    runs = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 5.0), ("a", 9, 100.0)], "series string, case_id int, total_s double")
    dims = spark.createDataFrame([(1, 100, 100, 100), (2, 200, 100, 100)], "case_id int, nx int, ny int, nz int")
    [row] = S.voxel_cost(runs, dims).collect()
    x, y = np.array([0.01, 0.02]), np.array([2.0, 5.0])
    assert row.slope == pytest.approx((x @ y) / (x @ x)) and row.ns_per_voxel == pytest.approx(row.slope * 10)


def test_throughput(spark):
    runs = spark.createDataFrame([("a", 2.0), ("a", 6.0), ("b", 0.0), ("c", None)], "series string, total_s double")
    got = {r.series: (r.n, r.per_s) for r in S.throughput(runs).collect()}
    assert got == {"a": (2, 0.25), "b": (1, None), "c": (1, None)}


def test_verdict(spark):
    def check(a, b):
        frames = [spark.createDataFrame(list(enumerate(v)), "k int, v double") for v in (a, b)]
        return S.max_error(*frames, on=["k"]).first()
    good = check([1.0, -4.0], [1.0002, -4.0])
    assert good.ok and good.relative == pytest.approx(0.0002 / 4) and good.n == 2
    assert not check([1.0, -4.0], [1.01, -4.0]).ok
    assert not check([1.0], [1.0, 2.0]).ok and not check([1.0, None], [1.0, 2.0]).ok and not check([float("nan")], [1.0]).ok
    assert check([0.0], [0.0]).ok and check([], []).ok
