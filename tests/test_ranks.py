"""Order statistics by narrowing ranges against sorted lists."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.operators import case_stats as S
from voxloom.operators import measure as M

INF = float("inf")


def groups():
    rng = np.random.default_rng(4)
    return {"one": [2.5], "ties": [1.0] * 9 + [2.0], "far": [-1e308, 1e308, 0.0, 1.0, 2.0, 1e-320, 5e-324], "ends": [-INF, INF, 3.0, 4.0, 5.0],
            "wide": [float(v) for v in rng.normal(0, 1, 300) ** 5], "near": [1.0 + k * 2.0 ** -52 for k in range(40)],
            "gaps": [None, 7.0, float("nan"), 8.0, None], "empty": [None]}


@pytest.mark.parametrize("buckets,finish", [(4096, 65_536), (4, 2), (2, 1)])
def test_any_rank(spark, buckets, finish):
    gs = groups()
    df = spark.createDataFrame([(g, v) for g, vs in gs.items() for v in vs], "g string, v double")
    ranks = [F.lit(0), F.expr("n div 3"), F.expr("n - 1"), F.col("n"), F.lit(-1)]
    got = {(r.g, r.k): (r.n, r.v) for r in M.rank_values(df, "v", ranks, ("g",), buckets, finish).collect()}
    want = {}
    for g, vs in gs.items():
        kept = sorted(v for v in vs if v is not None and v == v)
        for k, at in enumerate((0, len(kept) // 3, len(kept) - 1)):
            if kept:
                want[g, k] = (len(kept), kept[at])
    assert got == want


def test_median_of_integers_and_of_nothing(spark):
    df = spark.createDataFrame([(1, 4), (1, 1), (1, 9), (2, 3), (2, 6), (3, None)], "g int, v int")
    assert {r.g: r["median"] for r in M.exact_median(df, "v", ("g",), buckets=2, finish=1).collect()} == {1: 4.0, 2: 4.5}
    assert M.exact_median(df.where("g > 9"), "v", ("g",)).count() == 0


def test_summary_without_scores(spark):
    df = spark.createDataFrame([("a", None), ("b", 0.5), ("b", 0.9)], "series string, dice double")
    got = {r.series: r.median_dice for r in S.case_summary(df).collect()}
    assert got["a"] is None and got["b"] == pytest.approx(0.7)
