"""Grid changes: pooling, trilinear resampling, in-plane bilinear resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.operators.stencils import SLAB, with_z_neighbours
from voxloom.sources.tables import DIMS


def downsample2(slices: DataFrame, keys: tuple[str, ...] = ("case_id",), slab: int = SLAB) -> DataFrame:
    """2x average pooling; an odd last plane, row or column is dropped.

    The fine dims stay on the row as ``fx, fy, fz`` for the way back up.
    """
    near = with_z_neighbours(slices, 1, "data", keys, slab).where(
        (F.col("z") % 2 == 0) & (F.col("z") + 1 < F.col("nz")) & (F.col("nx") >= 2) & (F.col("ny") >= 2))
    half = {n: F.expr(f"cast({n} div 2 as int)") for n in DIMS}

    def cell(i: Column) -> Column:
        p = F.floor(i / half["nx"]) * 2 * F.col("nx") + (i % half["nx"]) * 2  # first of the four
        total = F.lit(0.0)
        for plane in ("data", "data_p1"):
            for dy in (0, 1):
                for dx in (0, 1):
                    total = total + F.get(F.col(plane), (p + dy * F.col("nx") + dx).cast("int"))
        return total * 0.125

    # Pooled before the dims are renamed: inside a lambda a name may bind to a new alias.
    pooled = near.withColumn("_pool", F.transform(F.sequence(F.lit(0), half["nx"] * half["ny"] - 1), cell))
    return pooled.select(
        *keys, F.expr("cast(z div 2 as int)").alias("z"),
        *[half[n].alias(n) for n in DIMS], F.col("_pool").alias("data"),
        *[F.col(n).alias(f) for n, f in zip(DIMS, ("fx", "fy", "fz"))])


def resampled_size(n: Column, spacing: Column, target: float) -> Column:
    """Voxels after respacing: rounded, up to a multiple of 8, at least 16."""
    want = F.round(n * spacing / F.lit(float(target)))
    return F.greatest(F.lit(16), (F.ceil(want / 8.0) * 8).cast("int"))


def trilinear(slices: DataFrame, size: tuple[Column, Column, Column],
              keys: tuple[str, ...] = ("case_id",), slab: int = SLAB) -> DataFrame:
    """Voxel rows of the grid resampled to ``size`` (corner-aligned).

    Every target slice lies between one source slice and the next, so source rows
    fan out to their target slices and no join is needed.
    """
    near = with_z_neighbours(slices, 1, "data", keys, slab)
    for axis, n in zip("xyz", size):
        near = near.withColumn(f"r{axis}", n)
        near = near.withColumn(f"s{axis}", (F.col(f"n{axis}") - 1).cast("double")
                               / F.greatest(F.lit(1), F.col(f"r{axis}") - 1))
    # A generous range of candidate target slices, then the exact membership test.
    lo = F.when(F.col("sz") > 0, F.greatest(F.lit(0), F.floor(F.col("z") / F.col("sz")).cast("int") - 1)) \
        .otherwise(F.lit(0))
    hi = F.when(F.col("sz") > 0, F.least(F.col("rz") - 1, F.ceil((F.col("z") + 1) / F.col("sz")).cast("int") + 1)) \
        .otherwise(F.col("rz") - 1)
    planes = (near.withColumn("oz", F.explode(F.sequence(lo, hi)))
              .where(F.floor(F.col("oz") * F.col("sz")) == F.col("z"))
              .withColumn("tz", F.col("oz") * F.col("sz") - F.col("z")))
    cells = planes.select(*keys, "oz", "tz", "nx", "ny", "rx", "ry", "rz", "sx", "sy", "data", "data_p1",
                          F.explode(F.sequence(F.lit(0), F.col("rx") * F.col("ry") - 1)).alias("_p"))
    cells = cells.select("*", (F.col("_p") % F.col("rx")).alias("ox"), F.expr("cast(_p div rx as int)").alias("oy"))
    cells = cells.select("*", F.floor(F.col("ox") * F.col("sx")).cast("int").alias("x0"),
                         F.floor(F.col("oy") * F.col("sy")).cast("int").alias("y0"))
    cells = cells.select("*", F.least(F.col("x0") + 1, F.col("nx") - 1).alias("x1"),
                         F.least(F.col("y0") + 1, F.col("ny") - 1).alias("y1"),
                         (F.col("ox") * F.col("sx") - F.col("x0")).alias("tx"),
                         (F.col("oy") * F.col("sy") - F.col("y0")).alias("ty"))

    def lerp(a: Column, b: Column, t: str) -> Column:
        return a * (1 - F.col(t)) + b * F.col(t)

    def corner(plane: str, y: str, x: str) -> Column:
        return F.get(F.col(plane), F.col(y) * F.col("nx") + F.col(x)).cast("double")

    def sheet(plane: str) -> Column:
        return lerp(lerp(corner(plane, "y0", "x0"), corner(plane, "y0", "x1"), "tx"),
                    lerp(corner(plane, "y1", "x0"), corner(plane, "y1", "x1"), "tx"), "ty")

    value = lerp(sheet("data"), sheet("data_p1"), "tz")
    return cells.select(*keys, F.col("ox").alias("x"), F.col("oy").alias("y"), F.col("oz").alias("z"),
                        F.col("rx").alias("nx"), F.col("ry").alias("ny"), F.col("rz").alias("nz"),
                        value.alias("value"))
