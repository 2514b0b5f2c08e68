"""Pointwise voxel expressions. All are built-in columns and stay in codegen."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# File and score conventions that results depend on.
HU_CLAMP = (-1024.0, 600.0)
MODEL_HU_RANGE = (-1000.0, 600.0)
EFFECT_SIZE_LIMITS = (0.147, 0.33, 0.474)
THIRD_TURN = 2.0943951023931953  # 2*pi/3


def clamp(v: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(v, F.lit(lo)), F.lit(hi))


def rescale(raw: Column, slope: float, inter: float) -> Column:
    """Affine decode; a stored slope of 0 means 1."""
    return raw * F.lit(slope if slope != 0 else 1.0) + F.lit(inter)


def in_band(v: Column, lo: float, hi: float) -> Column:
    return v.between(lo, hi)


def above(prob: Column, thr: float | Column) -> Column:
    """Strict threshold in single precision: 0.4 must not beat 0.4f."""
    t = thr if isinstance(thr, Column) else F.lit(float(thr))
    return prob.cast("float") > t.cast("float")


def normalize(v: Column, lo: float = MODEL_HU_RANGE[0], hi: float = MODEL_HU_RANGE[1]) -> Column:
    return (clamp(v, lo, hi) - F.lit(lo)) / F.lit(hi - lo)


def quantise8(unit: Column) -> Column:
    """[0,1] to 0..255, half to even."""
    return F.rint(clamp(unit * 255.0, 0.0, 255.0)).cast("int")


def softmax1(l0: Column, l1: Column) -> Column:
    """Second-class probability of a two-class logit pair, shifted by the maximum."""
    m = F.greatest(l0, l1)
    return F.exp(l1 - m) / (F.exp(l0 - m) + F.exp(l1 - m))


def argmax2(l0: Column, l1: Column) -> Column:
    return (l1 > l0).cast("int")


def hist_bin(v: Column, lo: float, hi: float, n: int) -> Column:
    """Truncate, then clamp into [0, n-1]; out-of-range values land in the end bins."""
    pos = (v - F.lit(float(lo))) / F.lit(float(hi - lo)) * F.lit(float(n))
    near = F.least(F.greatest(pos, F.lit(-1.0)), F.lit(float(n)))      # keeps the cast in range
    return F.least(F.greatest(near.cast("int"), F.lit(0)), F.lit(n - 1))


def linear_index(x: Column, y: Column, z: Column, nx: Column, ny: Column) -> Column:
    return (z.cast("long") * ny + y) * nx + x


def with_decoded(df: DataFrame, idx: str = "idx") -> DataFrame:
    """Invert ``linear_index``."""
    return (df.withColumn("x", F.expr(f"cast({idx} % nx as int)"))
            .withColumn("y", F.expr(f"cast(({idx} div nx) % ny as int)"))
            .withColumn("z", F.expr(f"cast({idx} div (cast(nx as bigint) * ny) as int)")))


def gaussian_taps(radius: int, sigma: float) -> list[float]:
    """Sampled, normalised bell of length ``2*radius + 1``."""
    if radius < 1:
        raise ValueError("radius must be at least 1")
    raw = [math.exp(-(k * k) / (2.0 * sigma * sigma)) for k in range(-radius, radius + 1)]
    total = math.fsum(raw)
    return [w / total for w in raw]


def effect_size(delta: Column) -> Column:
    a = F.abs(delta)
    small, medium, large = EFFECT_SIZE_LIMITS
    return (F.when(a < small, "negligible").when(a < medium, "small")
            .when(a < large, "medium").otherwise("large"))


def with_eigenvalues(df: DataFrame, h: tuple[str, ...], out: tuple[str, str, str]) -> DataFrame:
    """Eigenvalues of a symmetric 3x3 matrix, ordered by magnitude.

    ``h`` names the columns (xx, yy, zz, xy, xz, yz).  The trigonometric closed
    form is spelled as layered projections so each intermediate is evaluated once.
    """
    a, b, c, d, e, f = (F.col(n) for n in h)
    p = "_" + out[0] + "_"

    def col(n: str) -> Column:
        return F.col(p + n)

    step = df.select("*", (d * d + e * e + f * f).alias(p + "off"), ((a + b + c) / 3.0).alias(p + "q"))
    q = col("q")
    step = step.select("*", F.sqrt(((a - q) * (a - q) + (b - q) * (b - q) + (c - q) * (c - q)
                                    + 2.0 * col("off")) / 6.0).alias(p + "s"))
    inv = F.when(col("s") > 0, 1.0 / col("s")).otherwise(0.0)
    step = step.select("*", inv.alias(p + "i"))
    i = col("i")
    step = step.select("*", *[(v * i).alias(p + n) for n, v in
                              {"a": a - q, "b": b - q, "c": c - q, "d": d, "e": e, "f": f}.items()])
    A, B, C, D, E, G = (col(n) for n in "abcdef")
    det = A * (B * C - G * G) - D * (D * C - G * E) + E * (D * G - B * E)
    step = step.select("*", (F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), det * 0.5))) / 3.0)
                       .alias(p + "phi"))
    step = step.select("*", (q + 2.0 * col("s") * F.cos(col("phi"))).alias(p + "r1"),
                       (q + 2.0 * col("s") * F.cos(col("phi") + THIRD_TURN)).alias(p + "r3"))
    diagonal = col("off") == 0
    step = step.select(
        "*", F.when(diagonal, a).otherwise(col("r1")).alias(p + "l1"),
        F.when(diagonal, b).otherwise(3.0 * q - col("r1") - col("r3")).alias(p + "l2"),
        F.when(diagonal, c).otherwise(col("r3")).alias(p + "l3"))
    l1, l2, l3 = col("l1"), col("l2"), col("l3")
    m1, m2, m3 = F.abs(l1), F.abs(l2), F.abs(l3)
    step = step.select(
        "*",
        F.when((m1 <= m2) & (m1 <= m3), 1).when(m2 <= m3, 2).otherwise(3).alias(p + "lo"),
        F.when((m3 >= m1) & (m3 >= m2), 3).when(m2 >= m1, 2).otherwise(1).alias(p + "hi"))

    def pick(i: Column) -> Column:
        return F.when(i == 1, l1).when(i == 2, l2).otherwise(l3)

    keep = df.columns
    return step.select(*keep, pick(col("lo")).alias(out[0]),
                       pick(6 - col("lo") - col("hi")).alias(out[1]), pick(col("hi")).alias(out[2]))
