"""Masks as runs: one row per maximal x-interval of set voxels on a (z, y) line.

A run frame is 10-50x smaller than the voxels it stands for, so it is cut where the slices
lie (``slice_runs``, ``sweep_runs``) and only runs are ever shuffled.  Set algebra is one sweep
over interval ends per image line (``cover``); box morphology rasterises one slab of
runs at a time and turns the result back into runs, so it moves runs, not voxels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.operators.stencils import SLAB, with_halo
from voxloom.sources.tables import DIMS

BRICK_Z, BRICK_Y = 32, 512
#: Cells that one call of the run kernel holds at once.
PIECE = 1 << 22


def brick_columns(df: DataFrame, bz: int = BRICK_Z, by: int = BRICK_Y) -> DataFrame:
    return (df.withColumn("bz", F.expr(f"cast(z div {bz} as int)"))
            .withColumn("by", F.expr(f"cast(y div {by} as int)")))


def cells(fn: Callable[..., Column], *planes: str) -> Column:
    """Array of ``fn`` over the cells of a slice row; ``fn`` takes the planes' values, or values, x and y."""
    zipped = F.col(planes[0]) if len(planes) == 1 else F.arrays_zip(*planes)

    def values(cell: Column) -> list[Column]:
        return [cell] if len(planes) == 1 else [cell[p] for p in planes]

    if fn.__code__.co_argcount == len(planes):
        return F.transform(zipped, lambda cell: fn(*values(cell)))
    nx = F.col("nx")
    return F.transform(zipped, lambda cell, i: fn(*values(cell), i % nx, F.floor(i / nx).cast("int")))


def _spans(marked: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, first, last) of the maximal runs of set cells, lines of ``width`` one after the other."""
    lines = np.zeros((marked.size // width, width + 2), np.int8)
    lines[:, 1:-1] = marked.reshape(-1, width)
    turn = np.diff(lines, axis=1)
    line, first = np.nonzero(turn == 1)
    return line, first, np.nonzero(turn == -1)[1] - 1


def _whole_slices(batch: pa.RecordBatch, piece: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(row numbers, their cells end to end, line width) of slices of one width, about ``piece`` cells at a time."""
    lists = batch.column("_cells")
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    values = lists.flatten()
    if pa.types.is_boolean(values.type):
        values = pc.fill_null(values, False)
    values = values.to_numpy(zero_copy_only=False)
    nx, ny = (batch.column(d).to_numpy() for d in ("nx", "ny"))
    if ((size > 0) & (size != nx.astype(np.int64) * ny)).any():
        raise ValueError("a slice does not fill its grid")
    start = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    for width in np.unique(nx[size > 0]):
        rows = np.flatnonzero((nx == width) & (size > 0))
        part = (np.cumsum(size[rows], dtype=np.int64) - size[rows]) // piece
        for group in np.split(rows, np.flatnonzero(np.diff(part)) + 1):
            yield group, np.concatenate([values[start[r]:start[r + 1]] for r in group]), int(width)


def _cut(slices: DataFrame, marks: Column, keys: tuple[str, ...], field: T.StructField | None,
         passes: Callable[[np.ndarray], Iterator[tuple[object, np.ndarray]]], piece: int) -> DataFrame:
    """Runs of every (entry, marked cells) that ``passes`` makes of the cells; a narrow step, nothing is exchanged."""
    fields = [slices.schema[k] for k in keys] + ([field] if field is not None else []) \
        + [T.StructField(c, T.IntegerType()) for c in ("z", "y", "x0", "x1", *DIMS)]
    schema = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, flat, width in _whole_slices(batch, piece):
                lines = batch.column("ny").to_numpy()[rows].astype(np.int64)
                owner = np.repeat(rows, lines)
                within = np.arange(owner.size) - np.repeat(np.cumsum(lines) - lines, lines)
                for entry, marked in passes(flat):
                    line, x0, x1 = _spans(marked, width)
                    row = pa.array(owner[line])
                    columns = {c: batch.column(c).take(row) for c in (*keys, "z", *DIMS)}
                    columns |= {c: pa.array(v.astype(np.int32)) for c, v in (("y", within[line]), ("x0", x0), ("x1", x1))}
                    if field is not None:
                        columns[field.name] = pa.array(np.full(len(line), entry))
                    yield pa.RecordBatch.from_pydict({f.name: columns[f.name] for f in fields})

    whole = [F.col(c).cast("int").alias(c) for c in ("z", *DIMS)]
    return slices.select(*keys, *whole, marks.alias("_cells")).mapInArrow(run, schema)


def slice_runs(slices: DataFrame, marked: Column, keys: tuple[str, ...] = ("case_id",), piece: int = PIECE) -> DataFrame:
    """Runs of the cells that the boolean array ``marked`` sets, cut where each slice lies.

    A null array, and a null in it, sets nothing; an array of another length than its grid is an error.
    """
    return _cut(slices, marked, keys, None, lambda flat: [(None, flat)], piece)


def sweep_runs(slices: DataFrame, need: Column, bounds: dict, name: str, keys: tuple[str, ...] = ("case_id",),
               piece: int = PIECE) -> DataFrame:
    """Runs of many nested masks from one array: ``bounds`` maps an entry to its bound, cells with ``need <= bound`` are set.

    The entry is the column ``name``.  A slice travels to the kernel once, whatever the number of entries.
    """
    kind = T.DoubleType() if isinstance(next(iter(bounds)), float) else T.IntegerType()
    dtype = np.float64 if isinstance(kind, T.DoubleType) else np.int32
    levels = [(dtype(entry), bound) for entry, bound in bounds.items()]

    def passes(flat: np.ndarray):
        for entry, bound in levels:
            yield entry, flat <= bound       # a null is NaN and never set

    return _cut(slices, F.transform(need, lambda v: v.cast("double")), keys, T.StructField(name, kind), passes, piece)


def painted(masks: list[DataFrame], keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """Run masks as one byte array ``marks`` a slice: bit i of a cell says that mask i covers it.

    (keys, z, marks) for slices that any mask touches; a group holds the runs of one slice.
    """
    spans = [m.select(*keys, "z", "nx", "ny", F.struct(
        (F.col("y").cast("long") * F.col("nx") + F.col("x0")).alias("a"),
        (F.col("y").cast("long") * F.col("nx") + F.col("x1")).alias("b"), F.lit(i).alias("m")).alias("s"))
        for i, m in enumerate(masks)]
    every = spans[0]
    for more in spans[1:]:
        every = every.unionByName(more)
    held = every.groupBy(*keys, "z").agg(F.first("nx").alias("nx"), F.first("ny").alias("ny"), F.collect_list("s").alias("_s"))
    schema = T.StructType([*[every.schema[k] for k in keys], T.StructField("z", T.IntegerType()),
                           T.StructField("marks", T.ArrayType(T.ByteType()))])

    bits = range(len(masks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, nx, ny = batch.column("_s"), batch.column("nx").to_numpy(), batch.column("ny").to_numpy()
            for r in range(batch.num_rows):
                size = int(nx[r]) * int(ny[r])
                a, b, m = (lists[r].values.field(c).to_numpy() for c in "abm")
                marks = np.zeros(size, np.int8)
                for i in bits:
                    turn = np.zeros(size + 1, np.int32)
                    np.add.at(turn, a[m == i], 1)
                    np.add.at(turn, b[m == i] + 1, -1)
                    marks |= (turn.cumsum()[:-1] > 0).astype(np.int8) << i
                yield pa.RecordBatch.from_pydict({**{k: batch.column(k).slice(r, 1) for k in keys},
                                                  "z": batch.column("z").slice(r, 1).cast(pa.int32()),
                                                  "marks": pa.ListArray.from_arrays(pa.array([0, size], pa.int32()), pa.array(marks))})

    return held.mapInArrow(run, schema)


def to_runs(mask: DataFrame, keys: tuple[str, ...] = ("case_id",),
            bz: int = BRICK_Z, by: int = BRICK_Y) -> DataFrame:
    """Voxel rows to runs, for masks that no longer lie in slices.  One shuffle, by brick; the line
    window, the run aggregation and any later per-brick step all reuse that partitioning."""
    brick = [*keys, "bz", "by"]
    line = [*brick, "z", "y"]
    placed = brick_columns(mask.select(*keys, "x", "y", "z", *DIMS), bz, by).repartition(*brick)
    ranked = placed.withColumn(
        "_g", F.col("x") - F.row_number().over(Window.partitionBy(*line).orderBy("x")))
    return (ranked.groupBy(*line, *DIMS, "_g")
            .agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("_g"))


def to_voxels(runs: DataFrame, keys: tuple[str, ...] = ("case_id",), keep: tuple[str, ...] = ()) -> DataFrame:
    return runs.select(*keys, F.explode(F.sequence("x0", "x1")).alias("x"), "y", "z", *DIMS, *keep)


def cover(spans: DataFrame, line: list[str], need: Column) -> DataFrame:
    """Maximal intervals of each line covered by at least ``need`` spans."""
    events = (spans.select(*line, *[d for d in DIMS if d not in line],
                           F.explode(F.array(F.struct(F.col("x0").alias("at"), F.lit(1).alias("w")),
                                             F.struct((F.col("x1") + 1).alias("at"), F.lit(-1).alias("w"))))
                           .alias("e"))
              .groupBy(*line, *[d for d in DIMS if d not in line], F.col("e.at").alias("at"))
              .agg(F.sum("e.w").alias("w")))
    order = Window.partitionBy(*line).orderBy("at")
    depth = F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0))
    inside = events.withColumn("_in", depth >= need)
    turns = inside.withColumn("_was", F.coalesce(F.lag("_in").over(order), F.lit(False))) \
        .where(F.col("_in") != F.col("_was"))
    return (turns.withColumn("x1", F.lead("at").over(order) - 1).where("_in")
            .withColumnRenamed("at", "x0").drop("w", "_in", "_was"))


def _raster(z: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray, shape: tuple[int, int, int]) -> np.ndarray:
    turns = np.zeros((*shape[:2], shape[2] + 1), np.int16)
    np.add.at(turns, (z, y, x0), 1)
    np.add.at(turns, (z, y, x1 + 1), -1)
    return turns.cumsum(axis=2, dtype=np.int16)[:, :, :-1] > 0


def _box(mask: np.ndarray, margin: int, erode: bool) -> np.ndarray:
    """Box filter by running counts, axis by axis; windows are clipped, so outside never counts against."""
    for axis in (2, 1, 0):
        n = mask.shape[axis]
        counts = np.concatenate([np.zeros_like(np.take(mask, [0], axis), dtype=np.int32),
                                 mask.cumsum(axis=axis, dtype=np.int32)], axis=axis)
        hi, lo = np.minimum(np.arange(n) + margin, n - 1) + 1, np.maximum(np.arange(n) - margin, 0)
        held = np.take(counts, hi, axis) - np.take(counts, lo, axis)
        width = (hi - lo).reshape([-1 if k == axis else 1 for k in range(3)])
        mask = held == width if erode else held > 0
    return mask


def _morph(runs: DataFrame, steps: list[tuple[int, bool]], keys: tuple[str, ...], slab: int) -> DataFrame:
    """Apply box filters (margin, erode) in turn, slab by slab, in one shuffle of runs."""
    halo = sum(m for m, _ in steps)
    fields = [runs.schema[k] for k in keys] + [T.StructField(c, T.IntegerType()) for c in ("z", "y", "x0", "x1", *DIMS)]

    def work(group: pa.Table) -> pa.Table:
        z, y, x0, x1 = (group.column(c).to_numpy() for c in ("z", "y", "x0", "x1"))
        nx, ny, nz = (group.column(d)[0].as_py() for d in DIMS)
        start = group.column("slab")[0].as_py() * slab
        low, stop = max(start - halo, 0), min(start + slab, nz)
        mask = _raster(z - low, y, x0, x1, (min(stop + halo, nz) - low, ny, nx))
        for margin, erode_ in steps:
            mask = _box(mask, margin, erode_)
        own = np.pad(mask[start - low:stop - low], ((0, 0), (0, 0), (1, 1))).astype(np.int8)
        turn = np.diff(own, axis=2)
        oz, oy, first = np.nonzero(turn == 1)
        last = np.nonzero(turn == -1)[2] - 1
        columns = {k: pa.array([group.column(k)[0].as_py()] * len(oz), group.schema.field(k).type) for k in keys}
        for name, values in zip(("z", "y", "x0", "x1"), (oz + start, oy, first, last)):
            columns[name] = pa.array(values.astype(np.int32))
        return pa.table(columns | {d: pa.array(np.full(len(oz), v, np.int32)) for d, v in zip(DIMS, (nx, ny, nz))})

    placed = with_halo(runs.select(*keys, "z", "y", "x0", "x1", *DIMS), halo, slab)
    return placed.groupBy(*keys, "slab").applyInArrow(work, T.StructType(fields))


def dilate(runs: DataFrame, margin: int, keys: tuple[str, ...] = ("case_id",), slab: int = SLAB) -> DataFrame:
    """Box dilation: every voxel within ``margin`` of the mask on all axes."""
    return _morph(runs, [(margin, False)], keys, slab) if margin > 0 else runs


def erode(runs: DataFrame, margin: int, keys: tuple[str, ...] = ("case_id",), slab: int = SLAB) -> DataFrame:
    """Box erosion; everything outside the volume counts as set."""
    return _morph(runs, [(margin, True)], keys, slab) if margin > 0 else runs


def close(runs: DataFrame, margin: int, keys: tuple[str, ...] = ("case_id",), slab: int = SLAB) -> DataFrame:
    """Morphological closing: dilation, then erosion, in the same slab pass."""
    return _morph(runs, [(margin, False), (margin, True)], keys, slab) if margin > 0 else runs


def upsample2(runs: DataFrame, keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """Nearest 2x upsampling to the fine grid ``fx, fy, fz`` carried on each run.

    Coarse index ``c`` covers fine indices 2c and 2c+1; the last coarse index also
    covers an odd tail.
    """
    def fine(axis: str, coarse: str, full: str):
        c, n, m = F.col(axis), F.col(coarse), F.col(full)
        return 2 * c, F.when(c == n - 1, m - 1).otherwise(2 * c + 1)

    y0, y1 = fine("y", "ny", "fy")
    z0, z1 = fine("z", "nz", "fz")
    x1 = F.when(F.col("x1") == F.col("nx") - 1, F.col("fx") - 1).otherwise(2 * F.col("x1") + 1)
    rows = runs.withColumn("_z", F.explode(F.sequence(z0, z1))).withColumn("_y", F.explode(F.sequence(y0, y1)))
    return rows.select(*keys, F.col("_z").alias("z"), F.col("_y").alias("y"),
                       (2 * F.col("x0")).alias("x0"), x1.alias("x1"),
                       F.col("fx").alias("nx"), F.col("fy").alias("ny"), F.col("fz").alias("nz"))


def voxel_count(runs: DataFrame, keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    return runs.groupBy(*keys).agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("voxels"))
