"""Connected components and everything that is a question about components.

Flood fill, multi-seed region growing and exterior removal do not depend on visit
order: each is "keep (or drop) the components that contain a marked voxel".  So
there is one labelling operator and two set operators on labels.

Labelling works in three bounded steps:

1. runs of one brick (a fixed number of slices by a fixed number of lines) are
   labelled together, all bricks in parallel;
2. runs that face each other across brick borders give the edges of a much smaller
   graph of brick-local components;
3. that graph is contracted by repeated hook-to-smallest-neighbour rounds, each one
   checkpointed, until its measured size is under ``finish_rows``; what is left is
   resolved per key.

No step gathers a whole case, so a case that holds a third of the data is spread
over as many tasks as it has bricks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.operators.runs import BRICK_Y, BRICK_Z, brick_columns
from voxloom.session import cut

FINISH_ROWS = 2_000_000


def smallest_reachable(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node number of each node's component (hooking and pointer jumping)."""
    parent = np.arange(n)
    while a.size:
        ra, rb = parent[a], parent[b]
        open_ = ra != rb
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
    return parent


def _touching(line: np.ndarray, other: np.ndarray, x0: np.ndarray, x1: np.ndarray,
              width: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j): run j lies on line ``other[i]`` and overlaps run i.  Runs are sorted."""
    lo = np.searchsorted(line * width + x1, other * width + x0, "left")
    hi = np.searchsorted(line * width + x0, other * width + x1, "right")
    count = np.maximum(hi - lo, 0)
    i = np.repeat(np.arange(line.size), count)
    j = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
    return i, j


def _brick_labeller(volumetric: bool):
    def label(batch: pa.Table) -> pa.Table:
        z, y, x0, x1, nx, ny = (batch.column(c).to_numpy().astype(np.int64)
                                for c in ("z", "y", "x0", "x1", "nx", "ny"))
        order = np.lexsort((x0, y, z))
        z, y, x0, x1, nx, ny = z[order], y[order], x0[order], x1[order], nx[order], ny[order]
        width = int(x1.max()) + 2
        # Line numbers leave a gap after each slice so y+1 never meets the next z.
        rows = int(y.max()) + 2
        line = z * rows + y
        pairs = [_touching(line, line + 1, x0, x1, width)]
        if volumetric:
            pairs.append(_touching(line, line + rows, x0, x1, width))
        root = smallest_reachable(z.size, np.concatenate([p[0] for p in pairs]),
                                  np.concatenate([p[1] for p in pairs]))
        first = (z * ny + y) * nx + x0
        return batch.take(pa.array(order)).append_column("local", pa.array(first[root], pa.int64()))
    return label


def _facing(labelled: DataFrame, keys: tuple[str, ...], axis: str, size: int) -> DataFrame:
    """Label pairs that touch across the brick border normal to ``axis``."""
    other = "y" if axis == "z" else "z"
    a = labelled.where((F.col(axis) + 1) % size == 0).select(
        *keys, (F.col(axis) + 1).alias(axis), other, F.col("x0").alias("a0"), F.col("x1").alias("a1"),
        F.col("local").alias("u"))
    b = labelled.where((F.col(axis) % size == 0) & (F.col(axis) > 0)).select(
        *keys, axis, other, F.col("x0").alias("b0"), F.col("x1").alias("b1"), F.col("local").alias("v"))
    return (a.join(b, [*keys, axis, other])
            .where((F.col("a0") <= F.col("b1")) & (F.col("b0") <= F.col("a1")))
            .select(*keys, "u", "v").distinct())


def _resolve(edges: pa.Table, keys: tuple[str, ...]) -> pa.Table:
    nodes, where = np.unique(np.concatenate([edges.column("u").to_numpy(), edges.column("v").to_numpy()]),
                             return_inverse=True)
    m = edges.num_rows
    root = smallest_reachable(nodes.size, where[:m], where[m:])
    cols = {k: pa.array([edges.column(k)[0].as_py()] * nodes.size, edges.schema.field(k).type) for k in keys}
    return pa.table({**cols, "node": pa.array(nodes), "root": pa.array(nodes[root])})


def _contract(edges: DataFrame, keys: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """One round: every node adopts its smallest neighbour, choices are followed to their end, edges follow.

    Following doubles the distance each time, so a chain of n nodes takes about log2(n)
    joins and is one node after the round.
    """
    both = edges.unionByName(edges.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
    jump = cut(both.groupBy(*keys, "u").agg(F.min("v").alias("m")).select(
        *keys, F.col("u").alias("node"), F.least("u", "m").alias("root")))
    while True:
        up = jump.select(*keys, F.col("node").alias("root"), F.col("root").alias("_next"))
        step = cut(jump.join(up, [*keys, "root"], "left").select(
            *keys, "node", F.coalesce("_next", "root").alias("root"), (F.col("_next") < F.col("root")).alias("_moved")))
        jump = step.drop("_moved")
        if step.where("_moved").isEmpty():
            break
    for end in ("u", "v"):
        edges = edges.join(jump.select(*keys, F.col("node").alias(end), "root"), [*keys, end]) \
            .drop(end).withColumnRenamed("root", end)
    rest = edges.where("u <> v").select(
        *keys, F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    return jump, cut(rest)


def component_roots(edges: DataFrame, keys: tuple[str, ...] = ("case_id",),
                    finish_rows: int = FINISH_ROWS) -> DataFrame | None:
    """(keys, node, root) for every node that occurs in an edge; None without edges."""
    edges = cut(edges)
    left = edges.count()
    if left == 0:
        return None
    nodes = edges.select(*keys, F.col("u").alias("node")).unionByName(
        edges.select(*keys, F.col("v").alias("node"))).distinct()
    maps = []
    while left > finish_rows:
        jump, edges = _contract(edges, keys)
        maps.append(jump)
        left = edges.count()
    if left:
        schema = T.StructType([*[edges.schema[k] for k in keys],
                               T.StructField("node", T.LongType()), T.StructField("root", T.LongType())])
        last = edges.groupBy(*keys).applyInArrow(lambda t: _resolve(t, keys), schema)
        if not maps:
            return last
        maps.append(last)
    roots = nodes.withColumn("root", F.col("node"))
    for m in maps:
        step = m.select(*keys, F.col("node").alias("root"), F.col("root").alias("_next"))
        roots = roots.join(step, [*keys, "root"], "left") \
            .withColumn("root", F.coalesce("_next", "root")).drop("_next")
    return roots.select(*keys, "node", "root")


def components(runs: DataFrame, keys: tuple[str, ...] = ("case_id",), volumetric: bool = True,
               bz: int = BRICK_Z, by: int = BRICK_Y, finish_rows: int = FINISH_ROWS) -> DataFrame:
    """Label runs: ``label`` is the smallest linear index in the component.

    ``volumetric=False`` labels each slice on its own (4-connected in the plane).
    """
    brick = [*keys, "bz", "by"]
    if not {"bz", "by"} <= set(runs.columns):
        runs = brick_columns(runs, bz, by)
    schema = T.StructType([*runs.schema.fields, T.StructField("local", T.LongType())])
    labelled = cut(runs.groupBy(*brick).applyInArrow(_brick_labeller(volumetric), schema))
    if not volumetric and labelled.where("by > 0").isEmpty():
        return labelled.withColumn("label", F.col("local"))     # no slice spans two bricks
    edges = _facing(labelled, keys, "y", by)
    if volumetric:
        edges = edges.unionByName(_facing(labelled, keys, "z", bz))
    roots = component_roots(edges, keys, finish_rows)
    if roots is None:
        return labelled.withColumn("label", F.col("local"))
    named = roots.withColumnsRenamed({"node": "local", "root": "label"})
    return labelled.join(named, [*keys, "local"], "left") \
        .withColumn("label", F.coalesce("label", "local"))


def touched_labels(labelled: DataFrame, seeds: DataFrame, keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """Labels of the components that contain a seed voxel."""
    hit = labelled.join(seeds.select(*keys, "z", "y", F.col("x").alias("_sx")), [*keys, "z", "y"]) \
        .where(F.col("_sx").between(F.col("x0"), F.col("x1")))
    return hit.select(*keys, "label").distinct()


def region_grow(runs: DataFrame, seeds: DataFrame, keys: tuple[str, ...] = ("case_id",), **kw) -> DataFrame:
    """Multi-seed growth: the union of the components that contain a seed."""
    labelled = components(runs, keys, **kw)
    return labelled.join(touched_labels(labelled, seeds, keys), [*keys, "label"], "left_semi")


def without_exterior(runs: DataFrame, at_border: Column, keys: tuple[str, ...] = ("case_id",),
                     volumetric: bool = True, **kw) -> DataFrame:
    """Interior: drop the components with a run for which ``at_border`` holds."""
    labelled = components(runs, keys, volumetric, **kw)
    outer = labelled.where(at_border).select(*keys, "label").distinct()
    return labelled.join(outer, [*keys, "label"], "left_anti")


def lateral_border(x0=None, x1=None, y0=None, y1=None) -> Column:
    """Runs that reach the X or Y faces of the volume, or of the given window."""
    x0 = F.lit(0) if x0 is None else x0
    y0 = F.lit(0) if y0 is None else y0
    x1 = F.col("nx") - 1 if x1 is None else x1
    y1 = F.col("ny") - 1 if y1 is None else y1
    return (F.col("x0") <= x0) | (F.col("x1") >= x1) | (F.col("y") <= y0) | (F.col("y") >= y1)


def component_stats(labelled: DataFrame, keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """Size, coordinate sums and bounds per component, straight from runs."""
    n = (F.col("x1") - F.col("x0") + 1).cast("long")
    return labelled.groupBy(*keys, "label").agg(
        F.sum(n).alias("size"),
        F.sum(F.expr("(cast(x0 as bigint) + x1) * (x1 - x0 + 1) div 2")).alias("sum_x"),
        F.sum(n * F.col("y")).alias("sum_y"), F.sum(n * F.col("z")).alias("sum_z"),
        F.min("x0").alias("min_x"), F.max("x1").alias("max_x"),
        F.min("y").alias("min_y"), F.max("y").alias("max_y"),
        F.min("z").alias("min_z"), F.max("z").alias("max_z"))
