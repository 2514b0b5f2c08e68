"""Seed selection. Each run offers its one voxel nearest the axis, so a slice's seed is
an argmin over its runs and nothing is exploded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.operators.measure import with_bbox
from voxloom.session import attach, cut

CENTRAL_FRAC = 0.10
# How far the search is widened, and the share of slices that is enough.
WIDENING = (1.0, 1.5, 2.5)
LAST_FRAC = 0.5
ENOUGH_SLICES = 8


def _nearest(runs: DataFrame, bbox: DataFrame | None, keys: tuple[str, ...]) -> DataFrame:
    """Per slice: the voxel nearest the volume axis, and the first voxel in (y, x) order."""
    inside = with_bbox(runs, bbox, keys).where(
        F.col("y").between(F.col("by0"), F.col("by1")) & F.col("z").between(F.col("bz0"), F.col("bz1"))
        & (F.col("x1") >= F.col("bx0")) & (F.col("x0") <= F.col("bx1")))
    left, right = F.greatest("x0", "bx0"), F.least("x1", "bx1")
    cx, cy = F.expr("cast(nx div 2 as int)"), F.expr("cast(ny div 2 as int)")
    x = F.least(F.greatest(cx, left), right)
    d2 = (x - cx) * (x - cx) + (F.col("y") - cy) * (F.col("y") - cy)
    return inside.groupBy(*keys, "z").agg(
        F.min(F.struct(d2.alias("d2"), F.col("y"), x.alias("x"))).alias("near"),
        F.min(F.struct(F.col("y"), left.alias("x"))).alias("first"),
        F.first(F.least("nx", "ny")).alias("side"),
        F.first(F.col("bz1") - F.col("bz0") + 1).alias("span"))


def _radius(frac: float) -> Column:
    return (F.lit(float(frac)).cast("float") * F.col("side")).cast("int")


def axis_seeds(runs: DataFrame, bbox: DataFrame | None = None, frac: float = CENTRAL_FRAC,
               keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """One seed per slice: nearest to the volume axis within the central radius."""
    r = _radius(frac)
    return _nearest(runs, bbox, keys).where(F.col("near.d2") <= r * r).select(
        *keys, "z", F.col("near.y").alias("y"), F.col("near.x").alias("x"))


def axis_seeds_robust(runs: DataFrame, bbox: DataFrame | None = None, frac: float = CENTRAL_FRAC,
                      keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """Widen the radius until enough slices have a seed; at worst take any voxel per slice.

    The radii are nested, so one argmin per slice answers all of them: a radius finds
    a slice's seed exactly when the slice's nearest voxel lies inside it.
    """
    near = cut(_nearest(runs, bbox, keys))
    fracs = [frac * w for w in WIDENING] + [LAST_FRAC]
    found = [(F.col("near.d2") <= _radius(f) * _radius(f)) for f in fracs]
    counts = near.groupBy(*keys).agg(
        *[F.sum(c.cast("int")).alias(f"c{i}") for i, c in enumerate(found)], F.first("span").alias("_span"))
    enough = F.greatest(F.lit(ENOUGH_SLICES), F.expr("cast(_span div 4 as int)"))
    pick = F.lit(None).cast("int")
    for i in reversed(range(len(fracs))):
        pick = F.when(F.col(f"c{i}") >= enough, i).otherwise(pick)
    last = len(fracs) - 1
    choice = F.coalesce(pick, F.when(F.col(f"c{last}") > 0, last), F.lit(-1))
    chosen = attach(near, counts.select(*keys, choice.alias("_pick")), list(keys))
    accept = F.col("_pick") == -1
    for i, c in enumerate(found):
        accept = accept | ((F.col("_pick") == i) & c)
    spot = F.when(F.col("_pick") == -1, F.col("first")).otherwise(
        F.struct(F.col("near.y").alias("y"), F.col("near.x").alias("x")))
    return chosen.where(accept).select(*keys, "z", spot["y"].alias("y"), spot["x"].alias("x"))
