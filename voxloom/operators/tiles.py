"""Tiled model scoring: tile grid, gather, batched scoring, overlap average.

A scorer is any picklable callable from a float32 array to logits:
``[B,1,X,Y,Z] -> [B,2,X,Y,Z]`` for tiles and ``[B,3,S,S] -> [B,2,S,S]`` for slices.
Tiles are the unit of work: gathering one tile is one bounded group, whatever the
size of the case it comes from.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.functions.voxel import MODEL_HU_RANGE
from voxloom.operators.stencils import with_z_neighbours
from voxloom.sources.tables import DIMS

Scorer = Callable[[np.ndarray], np.ndarray]


def tile_starts(n: Column, patch: int, stride: int) -> Column:
    """Start positions along one axis; the last tile is flush with the end."""
    steps = F.sequence(F.lit(0), F.greatest(n - patch, F.lit(0)), F.lit(stride))
    flush = F.when((n > patch) & ((n - patch) % stride != 0), F.array(n - patch)) \
        .otherwise(F.array().cast("array<int>"))
    return F.when(n <= patch, F.array(F.lit(0))).otherwise(F.concat(steps, flush))


def tile_grid(cases: DataFrame, patch: int, stride: int, keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """One row per tile of every case: origin and valid extent."""
    out = cases
    for a in "zyx":
        out = out.withColumn(f"{a}_lo", F.explode(tile_starts(F.col(f"n{a}"), patch, stride)))
    return out.select(*keys, "z_lo", "y_lo", "x_lo", *[
        F.least(F.lit(patch), F.col(f"n{a}") - F.col(f"{a}_lo")).alias(f"{a}_len") for a in "zyx"])


def holding(n: Column, at: Column, patch: int, stride: int) -> Column:
    """Starts of the tiles that contain position ``at``: the range join as an explode.

    Only starts within a patch before ``at`` are formed, so the work does not grow with the axis.
    """
    last = F.greatest(n - patch, F.lit(0))
    low = (F.ceil(F.greatest(at - patch + 1, F.lit(0)) / stride) * stride).cast("int")
    high = F.least(at, last)
    steps = F.when(low <= high, F.sequence(low, high, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    flush = F.when(last % stride != 0, F.array(last)).otherwise(F.array().cast("array<int>"))
    return F.filter(F.concat(steps, flush), lambda s: (s <= at) & (at < s + patch))


def overlap_average(vox: DataFrame, patch: int, stride: int, score: Callable[..., Column],
                    keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """Mean over all tiles that hold a voxel of ``score(lx, ly, lz)`` (tile-local position).

    The tile list of a voxel is evaluated in place, once per axis, so there is no join and no shuffle.
    """
    def mean_over(axis: str, inner: Callable[[Column], Column]) -> Column:
        return F.aggregate(f"_s{axis}", F.lit(0.0), lambda acc, s: acc + inner(s))

    held = vox.select(*keys, "x", "y", "z", *DIMS, *[
        holding(F.col(f"n{a}"), F.col(a), patch, stride).alias(f"_s{a}") for a in "xyz"])
    hits = F.lit(1)
    for a in "xyz":
        hits = hits * F.size(f"_s{a}")
    total = mean_over("z", lambda sz: mean_over("y", lambda sy: mean_over("x", lambda sx: score(
        F.col("x") - sx, F.col("y") - sy, F.col("z") - sz))))
    return held.select(*keys, "x", "y", "z", *DIMS, hits.alias("hits"), (total / hits).alias("prob"))


def class1(logits: np.ndarray) -> np.ndarray:
    top = logits.max(axis=1, keepdims=True)
    e = np.exp(logits - top)
    return e[:, 1] / e.sum(axis=1)


class _Tile:
    """A tile being put together slice by slice: the model's input, and the rows that the answer goes back to."""

    def __init__(self, row: pa.RecordBatch, patch: int):
        ny, nx, ty, tx = (row.column(c)[0].as_py() for c in ("ny", "nx", "ty", "tx"))
        self.h, self.w, self.d, self.rows = min(patch, ny - ty), min(patch, nx - tx), 0, []
        self.values = np.zeros((patch,) * 3, np.float32)

    def add(self, part: pa.RecordBatch, told: list[str], lo: float, hi: float) -> None:
        raw = part.column("crop").flatten().to_numpy(zero_copy_only=False).astype(np.float32)
        unit = (np.clip(raw.reshape(part.num_rows, self.h, self.w), lo, hi) - np.float32(lo)) / np.float32(hi - lo)
        self.values[:self.w, :self.h, self.d:self.d + part.num_rows] = unit.transpose(2, 1, 0)
        self.d += part.num_rows
        # A copy, which does not keep the crops' buffers alive.
        self.rows.append(part.select(told).take(pa.array(np.arange(part.num_rows))))

    def answer(self, prob: np.ndarray) -> pa.RecordBatch:
        flat = np.ascontiguousarray(prob[:self.w, :self.h, :self.d].transpose(2, 1, 0), np.float32).reshape(-1)
        offsets = pa.array(np.arange(self.d + 1, dtype=np.int32) * (self.h * self.w))
        rows = pa.Table.from_batches(self.rows).combine_chunks().to_batches()[0]
        return rows.append_column("p", pa.ListArray.from_arrays(offsets, pa.array(flat)))


def score_tiles(slices: DataFrame, scorer: Scorer, patch: int = 128, stride: int = 128,
                lo: float = MODEL_HU_RANGE[0], hi: float = MODEL_HU_RANGE[1],
                keys: tuple[str, ...] = ("case_id",), batch: int = 1) -> DataFrame:
    """Sliding-window inference: slice rows in, slice rows of probabilities out.

    A task puts its tiles together one after another and asks the model for ``batch`` of
    them at a time, of whatever cases they are; it holds no more than these.
    """
    if batch < 1:
        raise ValueError("a batch has at least one tile")
    placed = slices.select(*keys, "z", *DIMS, "data")
    for a, at in (("z", F.col("z")), ("y", None), ("x", None)):
        starts = tile_starts(F.col(f"n{a}"), patch, stride) if at is None else \
            holding(F.col("nz"), at, patch, stride)
        placed = placed.withColumn(f"t{a}", F.explode(starts))
    # Send only the crop each tile needs, one slice at a time.
    rows = F.sequence(F.lit(0), F.least(F.lit(patch), F.col("ny") - F.col("ty")) - 1)
    crop = F.flatten(F.transform(rows, lambda r: F.slice(
        "data", ((F.col("ty") + r) * F.col("nx") + F.col("tx") + 1).cast("int"),
        F.least(F.lit(patch), F.col("nx") - F.col("tx")))))
    crops = placed.select(*keys, "tz", "ty", "tx", "z", *DIMS, crop.alias("crop"))
    fields = [slices.schema[k] for k in keys]
    ints = [T.StructField(c, T.IntegerType()) for c in ("z", *DIMS, "ty", "tx")]
    scored_schema = T.StructType(fields + ints + [T.StructField("p", T.ArrayType(T.FloatType()))])

    names = [*keys, "tz", "ty", "tx"]
    told = [*keys, "z", *DIMS, "ty", "tx"]

    def answers(tiles: list[_Tile]) -> Iterator[pa.RecordBatch]:
        prob = class1(np.asarray(scorer(np.stack([t.values for t in tiles])[:, None])))
        for tile, p in zip(tiles, prob, strict=True):
            yield tile.answer(p)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tile, waiting = None, None, []
        for rows in batches:
            places = list(zip(*(rows.column(c).to_pylist() for c in names)))
            cuts = [i for i in range(len(places)) if i == 0 or places[i] != places[i - 1]]
            for a, b in zip(cuts, [*cuts[1:], len(places)]):
                part = rows.slice(a, b - a)
                if places[a] != at:
                    waiting += [tile] if tile else []
                    if len(waiting) == batch:
                        yield from answers(waiting)
                        waiting = []
                    at, tile = places[a], _Tile(part, patch)
                tile.add(part, told, lo, hi)
        waiting += [tile] if tile else []
        if waiting:
            yield from answers(waiting)

    scored = crops.repartition(*names).sortWithinPartitions(*names, "z").mapInArrow(score, scored_schema)
    out_schema = T.StructType(fields + ints[:4] + [T.StructField("data", T.ArrayType(T.FloatType()))])

    def average_slice(group: pa.Table) -> pa.Table:
        nx, ny = group.column("nx")[0].as_py(), group.column("ny")[0].as_py()
        total, hits = np.zeros((ny, nx)), np.zeros((ny, nx))
        for ty, tx, p in zip(group.column("ty").to_pylist(), group.column("tx").to_pylist(), group.column("p")):
            h, w = min(patch, ny - ty), min(patch, nx - tx)
            total[ty:ty + h, tx:tx + w] += p.values.to_numpy().reshape(h, w)
            hits[ty:ty + h, tx:tx + w] += 1
        mean = (total / np.maximum(hits, 1)).astype(np.float32).reshape(-1)
        head = group.select([*keys, "z", *DIMS]).slice(0, 1)
        return head.append_column("data", pa.array([mean], pa.list_(pa.float32())))

    return scored.groupBy(*keys, "z").applyInArrow(average_slice, out_schema)


def bilinear(plane: np.ndarray, height: int, width: int) -> np.ndarray:
    """Corner-aligned bilinear resize of (..., H, W)."""
    for axis, n in ((-2, height), (-1, width)):
        size = plane.shape[axis]
        pos = np.arange(n) * np.float32((size - 1) / max(1, n - 1))
        i0 = np.minimum(pos.astype(int), size - 1)
        t = (pos - i0).astype(plane.dtype)
        t = t[:, None] if axis == -2 else t
        a, b = np.take(plane, i0, axis), np.take(plane, np.minimum(i0 + 1, size - 1), axis)
        plane = a * (1 - t) + b * t
    return plane


def score_slices(slices: DataFrame, scorer: Scorer, size: int = 256, batch: int = 16,
                 lo: float = MODEL_HU_RANGE[0], hi: float = MODEL_HU_RANGE[1],
                 keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """Slice-wise inference on (z-1, z, z+1) channels, each transposed and resized to ``size``."""
    near = with_z_neighbours(slices, 1, "data", keys).select(*keys, "z", *DIMS, "data_m1", "data", "data_p1")
    schema = T.StructType([slices.schema[k] for k in keys]
                          + [T.StructField(c, T.IntegerType()) for c in ("z", *DIMS)]
                          + [T.StructField("data", T.ArrayType(T.FloatType()))])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for start in range(0, rows.num_rows, batch):
                part = rows.slice(start, batch)
                shape = list(zip(part.column("ny").to_pylist(), part.column("nx").to_pylist()))
                chans = np.stack([np.stack([
                    bilinear(np.asarray(part.column(c)[i].values.to_numpy(zero_copy_only=False), np.float32)
                             .reshape(shape[i]).T, size, size) for c in ("data_m1", "data", "data_p1")])
                    for i in range(part.num_rows)])
                unit = (np.clip(chans, lo, hi) - np.float32(lo)) / np.float32(hi - lo)
                prob = class1(np.asarray(scorer(unit)))
                back = [bilinear(prob[i].astype(np.float32), shape[i][1], shape[i][0]).T.reshape(-1)
                        for i in range(part.num_rows)]
                cols = {c: part.column(c) for c in (*keys, "z", *DIMS)}
                yield pa.RecordBatch.from_pydict({**cols, "data": pa.array(back, pa.list_(pa.float32()))})

    return near.mapInArrow(score, schema)


def worker_cache() -> dict:
    """A dictionary that outlives single tasks in a reused Python worker."""
    return sys.modules.setdefault("_voxloom_worker", types.ModuleType("_voxloom_worker")).__dict__


class OnnxScorer:
    """Scorer backed by a model file; one session per Python worker, opened on first use."""

    def __init__(self, path: str, providers: tuple[str, ...] = ("CPUExecutionProvider",)):
        self.path, self.providers = path, providers

    def __call__(self, tensor: np.ndarray) -> np.ndarray:
        cache = worker_cache()
        session = cache.get(self.path)
        if session is None:
            import onnxruntime
            session = cache[self.path] = onnxruntime.InferenceSession(self.path, providers=list(self.providers))
        spec = session.get_inputs()[0]
        half = spec.type == "tensor(float16)"
        tensor = tensor.astype(np.float16 if half else np.float32)
        size = spec.shape[0] if isinstance(spec.shape[0], int) else len(tensor)     # some models fix their batch
        parts = []
        for start in range(0, len(tensor), size):
            part = tensor[start:start + size]
            full = np.concatenate((part, np.zeros((size - len(part), *part.shape[1:]), part.dtype)))
            parts.append(session.run(None, {spec.name: full})[0][:len(part)])
        return np.concatenate(parts).astype(np.float32)
