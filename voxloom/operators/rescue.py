"""Search for a tube-shaped component over a sweep of thresholds.

The sweep is one labelling: the threshold is a second key next to the case, and the runs
of all thresholds are cut from one pass over a slice.  The accepted threshold of a case
is then a plain minimum.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.operators.connect import component_stats, components
from voxloom.operators.measure import with_bbox
from voxloom.operators.runs import cells, sweep_runs
from voxloom.session import attach, cut


@dataclass(frozen=True)
class RescueParams:
    thresholds: tuple[float, ...] = tuple(float(t) for t in range(-950, -549, 25))
    z_share: float = 0.40
    min_depth: int = 20
    xy_share: float = 0.20
    min_half_width: int = 40
    min_size: int = 200
    size_share: int = 3
    min_length: int = 8
    max_diameter: int = 60
    min_aspect: float = 1.5


def search_window(slices: DataFrame, bbox: DataFrame | None, p: RescueParams, keys: tuple[str, ...]) -> DataFrame:
    """Add the window ``wx0..wz1``: low-z end of the body, around its centre."""
    out = with_bbox(slices, bbox, keys)
    depth = F.greatest(F.lit(p.min_depth), (F.lit(p.z_share).cast("float") * (F.col("bz1") - F.col("bz0") + 1)).cast("int"))
    cols = [F.col("bz0").alias("wz0"), F.least(F.col("bz0") + depth - 1, F.col("bz1")).alias("wz1")]
    for a in "xy":
        lo, hi = F.col(f"b{a}0"), F.col(f"b{a}1")
        mid = F.expr(f"cast((b{a}0 + b{a}1) div 2 as int)")
        half = F.greatest(F.lit(p.min_half_width), (F.lit(p.xy_share).cast("float") * (hi - lo + 1)).cast("int"))
        cols += [F.greatest(F.lit(0), mid - half).alias(f"w{a}0"),
                 F.least(F.col(f"n{a}") - 1, mid + half).alias(f"w{a}1")]
    return out.select("*", *cols)


def tube_score(stats: DataFrame, p: RescueParams) -> DataFrame:
    """Keep tube-shaped components; ``score`` favours long, large, central ones.

    Needs the component statistics plus ``wx0, wx1, wy0, wy1, wz0, wz1``.
    """
    def span(a: str) -> Column:
        return F.col(f"w{a}1") - F.col(f"w{a}0") + 1

    length = F.col("max_z") - F.col("min_z") + 1
    wide = F.greatest(F.col("max_x") - F.col("min_x") + 1, F.col("max_y") - F.col("min_y") + 1)
    aspect = length / wide.cast("double")
    off = sum((F.abs(F.col(f"sum_{a}") / F.col("size").cast("double") - F.col(f"w{a}0") - span(a) * 0.5)
               for a in "xy"), F.lit(0.0))
    volume = span("x").cast("long") * span("y") * span("z")
    return stats.where(
        (F.col("size") >= p.min_size) & (F.col("size") <= F.floor(volume / p.size_share))
        & (length >= p.min_length) & (wide <= p.max_diameter) & (aspect >= p.min_aspect)) \
        .withColumn("score", aspect * F.sqrt(F.col("size").cast("double")) / (1.0 + 0.05 * off))


def rescue_sweep(slices: DataFrame, bbox: DataFrame | None = None, p: RescueParams = RescueParams(),
                 keys: tuple[str, ...] = ("case_id",)) -> tuple[DataFrame, DataFrame]:
    """(accepted component per key, its seeds): lowest threshold with a tube wins."""
    sweep = (*keys, "thr")
    windowed = search_window(slices, bbox, p, keys)
    need = cells(lambda v, x, y: F.when(x.between(F.col("wx0"), F.col("wx1")) & y.between(F.col("wy0"), F.col("wy1")), v), "data")
    air = sweep_runs(windowed.where(F.col("z").between(F.col("wz0"), F.col("wz1"))), need,
                     {float(t): float(t) for t in p.thresholds}, "thr", keys)
    labelled = components(air, sweep)
    window = windowed.groupBy(*keys).agg(*[F.first(f"w{a}{n}").alias(f"w{a}{n}") for a in "xyz" for n in "01"])
    tubes = tube_score(attach(component_stats(labelled, sweep), window, list(keys)), p)
    best = tubes.groupBy(*sweep).agg(F.min(F.struct(
        (-F.col("score")).alias("s"), "label", "size", (F.col("sum_x") / F.col("size")).alias("cx"),
        (F.col("sum_y") / F.col("size")).alias("cy"))).alias("b"))
    found = cut(best.groupBy(*keys).agg(F.min(F.struct("thr", "b")).alias("f")).select(
        *keys, F.col("f.thr").alias("thr"), F.col("f.b.label").alias("label"), F.col("f.b.size").alias("voxels"),
        F.col("f.b.cx").alias("cx"), F.col("f.b.cy").alias("cy")))
    return found, component_seeds(labelled, found, sweep, keys)


def component_seeds(labelled: DataFrame, found: DataFrame, sweep: tuple[str, ...],
                    keys: tuple[str, ...]) -> DataFrame:
    """One seed per slice of the chosen component: the voxel nearest its centroid."""
    body = labelled.join(found, [*sweep, "label"])
    left = F.floor("cx").cast("int")
    spots = F.array(*[F.least(F.greatest(left + d, F.col("x0")), F.col("x1")) for d in (0, 1)])
    d2 = (F.col("_x") - F.col("cx")) * (F.col("_x") - F.col("cx")) + (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy"))
    return (body.withColumn("_x", F.explode(spots)).groupBy(*keys, "z")
            .agg(F.min(F.struct(d2.alias("d2"), F.col("y"), F.col("_x"))).alias("s"))
            .select(*keys, "z", F.col("s.y").alias("y"), F.col("s._x").alias("x")))
