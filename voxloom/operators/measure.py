"""Aggregations over voxel, run and case frames. All are partial/final hash aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.functions.voxel import above
from voxloom.operators.resample import downsample2
from voxloom.operators.stencils import gradient, positions, with_z_neighbours
from voxloom.session import attach, cut
from voxloom.sources.tables import DIMS

BBOX = ["bx0", "bx1", "by0", "by1", "bz0", "bz1"]


def body_bbox(vox: DataFrame, thr: float = -300.0, margin: int = 5, value: str = "hu",
              keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """Bounds of the voxels above ``thr``, grown by ``margin`` and clipped.

    A key without such voxels has no row; consumers read that as the whole volume.
    """
    ends = vox.where(F.col(value) > thr).groupBy(*keys).agg(
        *[f(a).alias(f"{a}{n}") for a in "xyz" for n, f in ((0, F.min), (1, F.max))],
        *[F.first(d).alias(d) for d in DIMS])
    low = [F.greatest(F.col(f"{a}0") - margin, F.lit(0)).alias(f"b{a}0") for a in "xyz"]
    high = [F.least(F.col(f"{a}1") + margin, F.col(f"n{a}") - 1).alias(f"b{a}1") for a in "xyz"]
    return ends.select(*keys, *low, *high)


def with_bbox(df: DataFrame, bbox: DataFrame | None, keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """Add the window columns; missing rows (or no window) mean the whole volume."""
    whole = {f"b{a}0": F.lit(0) for a in "xyz"} | {f"b{a}1": F.col(f"n{a}") - 1 for a in "xyz"}
    if bbox is None:
        return df.select("*", *[whole[c].alias(c) for c in BBOX])
    joined = attach(df, bbox, list(keys), "left")
    return joined.select(*df.columns, *[F.coalesce(F.col(c), whole[c]).alias(c) for c in BBOX])


def crop(vox: DataFrame, x: tuple[int, int], y: tuple[int, int], z: tuple[int, int]) -> DataFrame:
    """Window predicate on plain columns, so it reaches the scan of a stored voxel table."""
    return vox.where(F.col("x").between(*x) & F.col("y").between(*y) & F.col("z").between(*z))


def excess_ratio(low: Column, high: Column) -> Column:
    return F.when(high > 0, (low - high) / high.cast("double")).otherwise(F.lit(0.0))


def gate(vox: DataFrame, lo: float = 0.4, hi: float = 0.5, ratio: float = 0.5, prob: str = "prob",
         keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """Per-key threshold: fall back to ``hi`` when ``lo`` admits too many more voxels."""
    counts = vox.groupBy(*keys).agg(
        F.sum(above(F.col(prob), lo).cast("long")).alias("n_lo"),
        F.sum(above(F.col(prob), hi).cast("long")).alias("n_hi"))
    r = excess_ratio(F.col("n_lo") - 0, F.col("n_hi"))
    return counts.select("*", r.alias("ratio"),
                         F.when(r > ratio, F.lit(hi)).otherwise(F.lit(lo)).alias("thr"))


def hybrid_abort(vox: DataFrame, core: float = 0.5, floor: float = 0.1, limit: float = 0.8,
                 prob: str = "prob", keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """True where the uncertain band outweighs the confident core."""
    counts = vox.groupBy(*keys).agg(
        F.sum(above(F.col(prob), core).cast("long")).alias("n_core"),
        F.sum(above(F.col(prob), floor).cast("long")).alias("n_gate"))
    r = excess_ratio(F.col("n_gate"), F.col("n_core"))
    return counts.select("*", r.alias("ratio"), (r > limit).alias("abort"))


def prob_stats(vox: DataFrame, prob: str = "prob", keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    p = F.col(prob)
    return vox.groupBy(*keys).agg(F.avg(p.cast("double")).alias("mean_prob"), F.max(p).alias("max_prob"),
                                  F.sum(above(p, 0.5).cast("long")).alias("n_above"))


def dice_score(inter: Column, pred: Column, truth: Column) -> Column:
    return F.when(pred + truth > 0, 2.0 * inter / (pred + truth)).otherwise(F.lit(1.0))


def dice_of_flags(vox: DataFrame, pred: Column, truth: Column,
                  keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """Overlap score of two masks on the same rows: one pass, no join."""
    p, g = pred.cast("long"), truth.cast("long")
    sums = vox.groupBy(*keys).agg(F.sum(p).alias("pred"), F.sum(g).alias("gt"), F.sum(p * g).alias("inter"))
    return sums.withColumn("dice", dice_score(F.col("inter"), F.col("pred"), F.col("gt")))


def dice(pred: DataFrame, truth: DataFrame, keys: tuple[str, ...] = ("case_id",), cases: DataFrame | None = None) -> DataFrame:
    """Overlap score of two run masks: matching lines meet once, spans are intersected.

    A case without a run in either mask has no rows here; ``cases`` (the keys of all
    cases) gives those their score of 1.
    """
    length = (F.col("x1") - F.col("x0") + 1).cast("long")
    sizes = pred.select(*keys, length.alias("p"), F.lit(0).cast("long").alias("g"), F.lit(0).cast("long").alias("i")) \
        .unionByName(truth.select(*keys, F.lit(0).cast("long").alias("p"), length.alias("g"),
                                  F.lit(0).cast("long").alias("i")))
    a = pred.select(*keys, "z", "y", F.col("x0").alias("a0"), F.col("x1").alias("a1"))
    b = truth.select(*keys, "z", "y", F.col("x0").alias("b0"), F.col("x1").alias("b1"))
    both = a.join(b, [*keys, "z", "y"]).where("a0 <= b1 and b0 <= a1").select(
        *keys, F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("g"),
        (F.least("a1", "b1") - F.greatest("a0", "b0") + 1).cast("long").alias("i"))
    if cases is not None:
        none = [F.lit(0).cast("long").alias(c) for c in "pgi"]
        sizes = sizes.unionByName(cases.select(*keys, *none))
    sums = sizes.unionByName(both).groupBy(*keys).agg(
        F.sum("p").alias("pred"), F.sum("g").alias("gt"), F.sum("i").alias("inter"))
    return sums.withColumn("dice", dice_score(F.col("inter"), F.col("pred"), F.col("gt")))


def slice_profile(runs: DataFrame, keys: tuple[str, ...] = ("case_id",), carry: tuple[str, ...] = ()) -> DataFrame:
    """Area and bounding width and height of each non-empty slice; ``carry`` keeps grid sizes."""
    return runs.groupBy(*keys, "z").agg(
        F.sum(F.col("x1") - F.col("x0") + 1).alias("area"),
        (F.max("x1") - F.min("x0") + 1).alias("width"), (F.max("y") - F.min("y") + 1).alias("height"),
        *[F.first(c).alias(c) for c in carry])


def rank_values(values: DataFrame, value: str, ranks: list[Column], keys: tuple[str, ...], buckets: int = 4096,
                finish: int = 65_536) -> DataFrame:
    """Exact order statistics (keys, n, k, value): the value at each 0-based rank, ranks being functions of ``n``.

    Equal values are counted first.  Then the range that holds a rank narrows, for all keys and ranks in one job a
    round: its values are counted in ``buckets`` equal parts, the part with the rank becomes the next range, until
    no range has more than ``finish`` distinct values.  So no task orders more than ``finish`` or ``buckets`` + 1
    rows of a key.  Nulls and NaN are no values; ranks outside 0..n-1 and null keys have no row.
    """
    present = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    counted = cut(values.where(present).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c")))
    state = ["k", "n", "_r", "_lo", "_hi", "_d"]
    asked = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), r.cast("long").alias("_r")) for k, r in enumerate(ranks)]))
    ranges = cut(counted.groupBy(*keys).agg(
        F.sum("_c").alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count(F.lit(1)).alias("_d"))
        .select("*", asked.alias("_a")).select(*keys, "_a.k", "n", "_a._r", "_lo", "_hi", "_d").where("_r >= 0 and _r < n"))
    low, high, at = (F.col(c).cast("double") * 0.5 for c in ("_lo", "_hi", "_v"))
    # Both ends are parts of their own, so a range always narrows, infinite ends included.
    part = F.coalesce(F.floor(F.try_divide(at - low, high - low) * buckets), F.lit(1).cast("long"))
    part = F.when(F.col("_v") == F.col("_lo"), 0).when(F.col("_v") == F.col("_hi"), buckets) \
        .otherwise(F.least(F.greatest(part, F.lit(1)), F.lit(buckets - 1)))
    while not (wide := ranges.where(F.col("_d") > finish)).isEmpty():
        inside = attach(counted, cut(wide), list(keys)).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        parts = inside.groupBy(*keys, "k", "n", "_r", part.alias("_p")).agg(
            F.sum("_c").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count(F.lit(1)).alias("_d"))
        upto = F.sum("_c").over(Window.partitionBy(*keys, "k").orderBy("_p").rowsBetween(Window.unboundedPreceding, 0))
        held = parts.withColumn("_below", upto - F.col("_c")).where("_r >= _below and _r < _below + _c") \
            .withColumn("_r", F.col("_r") - F.col("_below"))
        ranges = cut(ranges.where(F.col("_d") <= finish).unionByName(held.select(*keys, *state)))
    inside = attach(counted, ranges, list(keys)).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
    upto = F.sum("_c").over(Window.partitionBy(*keys, "k").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    return inside.withColumn("_upto", upto).where("_r >= _upto - _c and _r < _upto").select(*keys, "n", "k", F.col("_v").alias(value))


def rank_pick(values: DataFrame, value: str, rank: Column, keys: tuple[str, ...]) -> DataFrame:
    """Exact order statistic: the value at 0-based ``rank`` (a function of ``n``)."""
    return rank_values(values, value, [rank], keys).drop("k")


def exact_median(values: DataFrame, value: str, keys: tuple[str, ...], **kw) -> DataFrame:
    """(keys, median): the mean of the two middle values, or the middle one."""
    middle = rank_values(values, value, [F.expr("(n - 1) div 2"), F.expr("n div 2")], keys, **kw)
    return middle.groupBy(*keys).agg(F.avg(value).alias("median"))


def prune_slices(runs: DataFrame, keys: tuple[str, ...] = ("case_id",), factor: int = 8,
                 slack: int = 50, min_fill: float = 0.5) -> DataFrame:
    """Drop slices whose area explodes past the typical one and that sprawl or are sparse."""
    profile = slice_profile(runs, keys, ("nx", "ny"))
    typical = rank_pick(profile, "area", F.expr("n div 2"), keys).select(*keys, F.col("area").alias("med"))
    leaked = attach(profile, typical, list(keys)).where(
        (F.col("area") > factor * F.col("med") + slack)
        & ((F.col("width") > F.expr("nx div 2")) | (F.col("height") > F.expr("ny div 2"))
           | (F.col("area") / (F.col("width") * F.col("height")) < min_fill))).select(*keys, "z")
    return runs.join(leaked, [*keys, "z"], "left_anti")


def adaptive_threshold(slices: DataFrame, body_thr: float = -300.0, k: float = 2.5,
                       core_frac: float = 0.30, air_ceiling: float = -600.0, grad_max: float = 80.0,
                       limits: tuple[float, float] = (-1010.0, -905.0), fallback: float = -960.0,
                       few: int = 50, keys: tuple[str, ...] = ("case_id",), coarse: DataFrame | None = None
                       ) -> DataFrame:
    """Air threshold of each case: low percentile of smooth air in the body core, plus a margin."""
    small = coarse if coarse is not None else downsample2(slices, keys)
    planes = ["data", "data_m1", "data_p1"]
    vox = positions(with_z_neighbours(small, 1, "data", keys), planes, list(keys))
    bbox = body_bbox(vox, body_thr, 0, "value", keys)
    near = with_bbox(vox, bbox, keys)

    def core(axis: str) -> Column:
        lo, hi, n = F.col(f"b{axis}0"), F.col(f"b{axis}1"), F.col(f"n{axis}")
        if axis == "z":
            a, b = lo, hi
        else:
            mid = F.expr(f"cast((b{axis}0 + b{axis}1) div 2 as int)")
            half = (F.lit(0.5 * core_frac) * (hi - lo + 1)).cast("int") + 1
            a, b = mid - half, mid + half
        return (F.col(axis) >= F.greatest(a, F.lit(1))) & (F.col(axis) <= F.least(b, n - 2))

    air = near.where(core("x") & core("y") & core("z") & (F.col("value") < air_ceiling)
                     & (gradient("data_m1", "data", "data_p1") <= grad_max)).select(*keys, "value")
    floor = rank_pick(air, "value", F.floor(F.lit(0.05) * F.col("n")), keys)
    everyone = small.where("z = 0").select(*keys)
    thr = F.least(F.greatest(F.col("value") + 30.0 * k, F.lit(limits[0])), F.lit(limits[1]))
    return everyone.join(floor, list(keys), "left").select(
        *keys, F.coalesce("n", F.lit(0)).alias("n_air"),
        F.when(F.coalesce("n", F.lit(0)) < few, F.lit(fallback)).otherwise(thr).alias("thr"))
