"""Safety decisions on per-case summary rows: pure columns, no data movement."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SafetyParams:
    ratio: float = 2.5
    ratio2: float = 1.5
    abs_cap: int = 600_000
    pyramid_floor: int = 80_000
    dual: bool = True
    rescue_min: int = 15_000
    rescue_cap: int = 600_000
    swap_floor: int = 20_000
    swap_ratio: float = 10.0
    swap_rescue_ratio: float = 4.0


def revert_to_pyramid(grown: Column, pyramid: Column, p: SafetyParams) -> Column:
    """A runaway growth, relative to a pyramid mask that is itself big enough to trust."""
    rule = grown > F.floor(F.lit(p.ratio) * pyramid)
    if p.dual:
        rule = rule | ((grown > p.abs_cap) & (grown > F.floor(F.lit(p.ratio2) * pyramid)))
    return (pyramid >= p.pyramid_floor) & rule


def wants_rescue(voxels: Column, p: SafetyParams) -> Column:
    return voxels < p.rescue_min


def keep_rescue(before: Column, rescued: Column, p: SafetyParams) -> Column:
    """Take the rescue only if it adds voxels without leaking."""
    return (rescued <= p.rescue_cap) & (rescued > before)


def swap_for_model(voxels: Column, anchored: Column, rescued: Column, p: SafetyParams) -> Column:
    """Replace a mask far larger than the model-anchored one; stricter after a rescue."""
    far = voxels > F.floor(F.lit(p.swap_ratio) * anchored)
    after = rescued & (voxels > F.floor(F.lit(p.swap_rescue_ratio) * anchored))
    return (anchored >= p.swap_floor) & (far | after)


def decide(summary: DataFrame, p: SafetyParams = SafetyParams()) -> DataFrame:
    """Apply the rules in order to (wavefront, pyramid, rescue, anchored) voxel counts."""
    w, y, r, m = (F.col(c) for c in ("wavefront", "pyramid", "rescue", "anchored"))
    step = summary.withColumn("reverted", revert_to_pyramid(w, y, p))
    step = step.withColumn("_v", F.when(F.col("reverted"), y).otherwise(w))
    step = step.withColumn("rescued", wants_rescue(F.col("_v"), p) & keep_rescue(F.col("_v"), r, p))
    step = step.withColumn("_v", F.when(F.col("rescued"), r).otherwise(F.col("_v")))
    step = step.withColumn("swapped", swap_for_model(F.col("_v"), m, F.col("rescued"), p))
    source = (F.when(F.col("swapped"), "anchored").when(F.col("rescued"), "rescue")
              .when(F.col("reverted"), "pyramid").otherwise("wavefront"))
    return step.select(*summary.columns, "reverted", "rescued", "swapped", source.alias("source"),
                       F.when(F.col("swapped"), m).otherwise(F.col("_v")).alias("final_voxels"))
