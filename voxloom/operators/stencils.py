"""Neighbourhood operators on slice rows.

Only the z direction crosses rows.  Slices are grouped into slabs of a fixed depth
and the few slices near a slab border are sent to both slabs, so one shuffle of
whole slices (four bytes a voxel, not one row a voxel) serves all three axes and
no task ever holds more than ``slab + 2*halo`` slices.

First and second differences are then plain array look-ups inside generated code.
Long separable kernels are the exception: array convolution has no built-in, so
each slab is smoothed by a few vectorised NumPy lines in an Arrow group.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.functions.voxel import THIRD_TURN, gaussian_taps
from voxloom.session import attach, cut
from voxloom.sources.tables import DIMS

SLAB = 32
CHUNK_VOXELS = 1 << 18


def with_halo(slices: DataFrame, halo: int, slab: int = SLAB) -> DataFrame:
    """Copy each slice to every slab that needs it (its own, plus a border copy)."""
    first = F.expr(f"cast(greatest(z - {halo}, 0) div {slab} as int)")
    last = F.expr(f"cast(least(z + {halo}, nz - 1) div {slab} as int)")
    return slices.withColumn("slab", F.explode(F.sequence(first, last)))


def with_z_neighbours(slices: DataFrame, radius: int = 1, data: str = "data",
                      keys: tuple[str, ...] = ("case_id",), slab: int = SLAB) -> DataFrame:
    """Add ``<data>_m<k>`` and ``<data>_p<k>``: the slices k below and above, edge-clamped."""
    order = Window.partitionBy(*keys, "slab").orderBy("z")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cols = []
    for k in range(1, radius + 1):
        cols += [F.coalesce(F.lag(data, k).over(order), F.first(data).over(whole)).alias(f"{data}_m{k}"),
                 F.coalesce(F.lead(data, k).over(order), F.last(data).over(whole)).alias(f"{data}_p{k}")]
    return (with_halo(slices, radius, slab).select("*", *cols)
            .where(F.expr(f"slab = z div {slab}")).drop("slab"))


def at(plane: str, dx: int = 0, dy: int = 0) -> Column:
    """Value of an in-row slice array at (x+dx, y+dy), clamped to the slice."""
    x = F.least(F.greatest(F.col("x") + dx, F.lit(0)), F.col("nx") - 1) if dx else F.col("x")
    y = F.least(F.greatest(F.col("y") + dy, F.lit(0)), F.col("ny") - 1) if dy else F.col("y")
    return F.get(F.col(plane), y * F.col("nx") + x)


def positions(slices: DataFrame, planes: list[str], keep: list[str]) -> DataFrame:
    """One row per in-plane position; ``planes`` stay available to ``at``."""
    return (slices.select(*keep, "z", *DIMS, *planes, F.posexplode(planes[0]).alias("_p", "value"))
            .select(*keep, (F.col("_p") % F.col("nx")).cast("int").alias("x"),
                    F.expr("cast(_p div nx as int)").alias("y"), "z", *DIMS, *planes, "value"))


def gradient(down: str, here: str, up: str) -> Column:
    gx = 0.5 * (at(here, 1) - at(here, -1))
    gy = 0.5 * (at(here, 0, 1) - at(here, 0, -1))
    gz = 0.5 * (at(up) - at(down))
    return F.sqrt(gx * gx + gy * gy + gz * gz)


def gradient_magnitude(slices: DataFrame, data: str = "data",
                       keys: tuple[str, ...] = ("case_id",), slab: int = SLAB) -> DataFrame:
    """Voxel rows with ``value`` and ``grad`` (half central differences, clamped)."""
    near = with_z_neighbours(slices, 1, data, keys, slab)
    planes = [data, f"{data}_m1", f"{data}_p1"]
    return positions(near, planes, list(keys)).withColumn(
        "grad", gradient(planes[1], data, planes[2])).drop(*planes)


def hessian(down: str, here: str, up: str, scale: float = 1.0) -> dict[str, Column]:
    """Second differences from three neighbouring slices, times ``scale``."""
    s = F.lit(float(scale))
    c2 = 2.0 * at(here)
    return {
        "hxx": (at(here, 1) - c2 + at(here, -1)) * s,
        "hyy": (at(here, 0, 1) - c2 + at(here, 0, -1)) * s,
        "hzz": (at(up) - c2 + at(down)) * s,
        "hxy": 0.25 * (at(here, 1, 1) - at(here, -1, 1) - at(here, 1, -1) + at(here, -1, -1)) * s,
        "hxz": 0.25 * (at(up, 1) - at(up, -1) - at(down, 1) + at(down, -1)) * s,
        "hyz": 0.25 * (at(up, 0, 1) - at(up, 0, -1) - at(down, 0, 1) + at(down, 0, -1)) * s,
    }


def _along(volume: np.ndarray, taps: list[float], axis: int) -> np.ndarray:
    """Weighted sum of edge-clamped shifts, accumulated from the lowest tap up."""
    n, r = volume.shape[axis], len(taps) // 2
    total = None
    for k, w in enumerate(taps):
        term = w * np.take(volume, np.clip(np.arange(n) + k - r, 0, n - 1), axis=axis)
        total = term if total is None else total + term
    return total


def _planes(volume: np.ndarray) -> pa.Array:
    flat = pa.array(np.ascontiguousarray(volume).reshape(-1))
    width = volume[0].size
    return pa.ListArray.from_arrays(pa.array(np.arange(len(volume) + 1, dtype=np.int32) * width), flat)


def per_slab(slices: DataFrame, names: list[str], halo: int, compute: Callable[..., dict[str, np.ndarray]],
             keys: tuple[str, ...] = ("case_id",), slab: int = SLAB, data: str = "data",
             carry: bool = False) -> DataFrame:
    """Run ``compute(volume, z, own, nz)`` on each slab with its halo; keep the slab's own slices.

    ``volume`` is float64 ``[z, y, x]``, ``own`` the positions to answer for.  One array
    column per name comes back, next to the dims (and the input slice with ``carry``).
    """
    fields = [slices.schema[k] for k in keys] + [T.StructField(c, T.IntegerType()) for c in ("z", *DIMS)]
    if carry:
        fields.append(slices.schema[data])
    schema = T.StructType(fields + [T.StructField(n, T.ArrayType(T.DoubleType())) for n in names])
    heads = [f.name for f in fields]

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("z").combine_chunks()
        z = group.column("z").to_numpy()
        nx, ny, nz = (group.column(d)[0].as_py() for d in DIMS)
        own = np.flatnonzero(z // slab == group.column("slab")[0].as_py())
        volume = group.column(data).chunk(0).flatten().to_numpy(zero_copy_only=False) \
            .astype(np.float64).reshape(len(z), ny, nx)
        out = compute(volume, z, own, nz)
        columns = {c: group.column(c).take(pa.array(own)) for c in heads}
        return pa.table(columns | {n: _planes(out[n]) for n in names})

    placed = with_halo(slices.select(*keys, "z", *DIMS, data), halo, slab)
    return placed.groupBy(*keys, "slab").applyInArrow(run, schema)


def _smoothed(volume: np.ndarray, chain: list[list[float]], axes: str = "xyz") -> np.ndarray:
    for taps in chain:
        for axis in axes:
            volume = _along(volume, taps, "zyx".index(axis))
    return volume


def reach_of(kernels: dict[str, list[list[float]]]) -> int:
    return max(sum(len(t) // 2 for t in chain) for chain in kernels.values())


def smooth(slices: DataFrame, kernels: dict[str, list[list[float]]], axes: str = "xyz",
           keys: tuple[str, ...] = ("case_id",), slab: int = SLAB, data: str = "data") -> DataFrame:
    """Separable smoothing of slice rows; one output array per named kernel.

    ``kernels`` maps a name to one or more tap lists applied in turn (more than one
    gives the incremental, scale-to-scale form).
    """
    def compute(volume, z, own, nz):
        return {n: _smoothed(volume, chain, axes)[own] for n, chain in kernels.items()}

    return per_slab(slices, list(kernels), reach_of(kernels) if "z" in axes else 0, compute, keys, slab, data)


def gaussian(slices: DataFrame, radius: int = 2, sigma: float = 1.0, **kw) -> DataFrame:
    return smooth(slices, {"smoothed": [gaussian_taps(radius, sigma)]}, **kw)


def scale_kernels(sigmas: tuple[float, ...], incremental: bool) -> dict[str, list[list[float]]]:
    """Tap chains per scale: direct, or smoothing each scale from the one before."""
    chains, chain, before = {}, [], 0.0
    for i, sigma in enumerate(sigmas):
        step = (sigma ** 2 - before ** 2) ** 0.5 if incremental else sigma
        taps = gaussian_taps(max(1, int(np.ceil(3 * step))), step)
        chain = [*chain, taps] if incremental else [taps]
        before = sigma
        chains[f"s{i}"] = chain
    return chains


def _tubes(volume: np.ndarray, z: np.ndarray, own: np.ndarray, nz: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Shape part and squared strength of the dark-tube measure on the own slices (0 elsewhere)."""
    planes = {dz: volume[np.clip(z[own] + dz, 0, nz - 1) - z[0]] for dz in (-1, 0, 1)}

    def v(dx: int = 0, dy: int = 0, dz: int = 0) -> np.ndarray:
        p = planes[dz]
        p = p if not dy else np.take(p, np.clip(np.arange(p.shape[1]) + dy, 0, p.shape[1] - 1), 1)
        return p if not dx else np.take(p, np.clip(np.arange(p.shape[2]) + dx, 0, p.shape[2] - 1), 2)

    c2 = 2.0 * v()
    a, b, c = ((v(**{k: 1}) - c2 + v(**{k: -1})) * scale for k in ("dx", "dy", "dz"))
    d, e, f = (0.25 * (v(**{i: 1, j: 1}) - v(**{i: -1, j: 1}) - v(**{i: 1, j: -1}) + v(**{i: -1, j: -1})) * scale
               for i, j in (("dx", "dy"), ("dx", "dz"), ("dy", "dz")))
    off = d * d + e * e + f * f
    q = (a + b + c) / 3.0
    s = np.sqrt(((a - q) * (a - q) + (b - q) * (b - q) + (c - q) * (c - q) + 2.0 * off) / 6.0)
    inv = np.divide(1.0, s, out=np.zeros_like(s), where=s > 0)
    A, B, C, D, E, G = (m * inv for m in (a - q, b - q, c - q, d, e, f))
    half = (A * (B * C - G * G) - D * (D * C - G * E) + E * (D * G - B * E)) * 0.5
    phi = np.arccos(np.clip(half, -1.0, 1.0)) / 3.0
    r1, r3 = q + 2.0 * s * np.cos(phi), q + 2.0 * s * np.cos(phi + THIRD_TURN)
    roots = np.where(off == 0, np.stack([a, b, c]), np.stack([r1, 3.0 * q - r1 - r3, r3]))
    e1, e2, e3 = np.take_along_axis(roots, np.argsort(np.abs(roots), axis=0, kind="stable"), 0)
    dark = (e2 > 0) & (e3 > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        ra, rb = np.abs(e2) / np.abs(e3), np.abs(e1) / np.sqrt(np.abs(e2 * e3))
        shape = (1.0 - np.exp(-(ra * ra) / 0.5)) * np.exp(-(rb * rb) / 0.5)
    return np.where(dark, shape, 0.0), np.where(dark, e1 * e1 + e2 * e2 + e3 * e3, 0.0)


def vesselness(slices: DataFrame, sigmas: tuple[float, ...] = (1.0, 2.0, 3.0),
               incremental: bool = False, keys: tuple[str, ...] = ("case_id",),
               slab: int = SLAB, carry: bool = False, marks: DataFrame | None = None) -> DataFrame:
    """Multi-scale dark-tube measure in [0, 1]: voxel rows with ``vness``.

    Each slab is smoothed at all scales and reduced to two numbers per voxel and scale,
    in one shuffle.  (As columns, three scales of eigenvalues make generated methods
    too long for the JIT, about ten times slower.)  The only global quantity, the
    largest structure strength per key and scale, is taken slice by slice without
    exploding voxels and comes back by a size-checked broadcast.  ``carry`` adds ``hu``, ``marks`` (keys, z, an array a slice)
    the cell's ``_in``: slices meet slices, voxel rows are made after the join.
    """
    kernels = scale_kernels(sigmas, incremental)
    count = range(len(sigmas))

    def compute(volume, z, own, nz):
        out = {}
        step = max(1, CHUNK_VOXELS // volume[0].size)      # bounds the temporaries, whatever the plane
        for i, (chain, sigma) in enumerate(zip(kernels.values(), sigmas)):
            soft = _smoothed(volume, chain)
            pieces = [_tubes(soft, z, own[k:k + step], nz, sigma * sigma) for k in range(0, len(own), step)]
            out[f"shape{i}"], out[f"str{i}"] = (np.concatenate(p) for p in zip(*pieces))
        return out

    planes = [f"{n}{i}" for i in count for n in ("shape", "str")]
    # Kept, as they are read twice: for the largest strength and for the scores.
    parts = cut(per_slab(slices, planes, reach_of(kernels) + 1, compute, keys, slab, carry=carry))
    top = parts.groupBy(*keys).agg(*[F.max(F.array_max(f"str{i}")).alias(f"top{i}") for i in count])
    extra = ["data"] if carry else []
    whole = attach(parts, top, list(keys))
    if marks is not None:
        whole = whole.join(marks, [*keys, "z"], "left")
        extra.append("marks")
    vox = positions(whole, [*planes, *extra], [*keys, *[f"top{i}" for i in count]])
    # c is half the largest strength S, so 2*c*c = S*S/2.
    scores = [F.when(F.col(f"top{i}") > 0, at(f"shape{i}") * (
        1.0 - F.exp(-at(f"str{i}") / (0.5 * F.col(f"top{i}"))))).otherwise(F.lit(0.0)) for i in count]
    more = ([at("data").alias("hu")] if carry else []) + ([at("marks").alias("_in")] if marks is not None else [])
    return vox.select(*keys, "x", "y", "z", *DIMS, *more, F.greatest(F.lit(0.0), *scores).alias("vness"))


def slice_triplet(slices: DataFrame, keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """(below, here, above) per slice, clamped within the case."""
    near = with_z_neighbours(slices, 1, "data", keys)
    return near.select(*keys, "z", *DIMS, F.col("data_m1").alias("below"), "data",
                       F.col("data_p1").alias("above"))

