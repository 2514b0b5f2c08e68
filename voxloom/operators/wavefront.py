"""Layer-by-layer growth with a depth-relaxed threshold, explosion test and rollback.

The accept rules depend on the size of each whole layer, so layers are a true
sequence.  Two forms compute the same result:

* keys whose *eligible* voxels (a sparse set: only what could ever be accepted) are
  counted and found to fit one task are grown as independent Arrow groups;
* keys above that count run layer by layer as joins over the cluster, all such keys
  in one loop, each layer checkpointed.  Their books (cap, recent layer sizes) are a
  frame with a row a key, brought up to date by an aggregate of each layer.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.functions.voxel import linear_index, with_decoded
from voxloom.session import BROADCAST_ROWS, attach, cut
from voxloom.sources.tables import DIMS

TASK_VOXELS = 4_000_000
SLOTS = 5


@dataclass(frozen=True)
class WavefrontParams:
    thr_trunk: float = -950.0
    thr_periph: float = -820.0
    max_level: int = 60
    vmin: float = 0.03
    leak_factor: float = 3.0
    leak_base: int = 800
    leak_ratio: float = 3.0
    cap_base: int = 5000
    hu_abs_max: float = -500.0

    def ceiling(self, level: int) -> float:
        """Relaxed HU ceiling of a layer, in the single precision of the voxel values."""
        share = np.minimum(np.float32(level) * (np.float32(1) / np.float32(max(self.max_level, 1))), np.float32(1))
        return float(np.float32(self.thr_trunk) + share * np.float32(self.thr_periph - self.thr_trunk))


class Baseline:
    """Mean of the last stored layer sizes.

    After the slots fill, only the first one is replaced, so the mean covers the
    latest layer and layers two to five.
    """

    def __init__(self) -> None:
        self.sizes: list[float] = []

    def mean(self) -> float:
        return sum(self.sizes) / len(self.sizes) if self.sizes else 0.0

    def store(self, size: int) -> None:
        if len(self.sizes) < SLOTS:
            self.sizes.append(float(size))
        else:
            self.sizes[0] = float(size)

    def explodes(self, size: int, p: WavefrontParams) -> bool:
        mean = self.mean()
        return size > p.leak_base and (mean <= 0 or size > p.leak_factor * mean)


def eligible(vox: DataFrame, p: WavefrontParams, keys: tuple[str, ...]) -> DataFrame:
    """Voxels that some layer could accept, with their linear index."""
    ceiling = min(max(p.thr_trunk, p.thr_periph), p.hu_abs_max)
    open_ = F.col("hard") | ((F.col("hu") <= ceiling) & (F.col("vness") >= p.vmin))
    return vox.where(F.col("roi") & open_).select(
        *keys, *DIMS, linear_index(F.col("x"), F.col("y"), F.col("z"), F.col("nx"), F.col("ny")).alias("idx"),
        F.col("hu").cast("double").alias("hu"), "hard",
        (F.col("vness") >= p.vmin).alias("tubular"), "x", "y", "z")


def _grow_in_task(p: WavefrontParams):
    def grow(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("idx").to_numpy())
        group = group.take(pa.array(order))
        idx, hu = group.column("idx").to_numpy(), group.column("hu").to_numpy()
        hard = group.column("hard").to_numpy().astype(bool)
        soft = group.column("tubular").to_numpy().astype(bool) & (hu <= p.hu_abs_max)
        nx, ny = group.column("nx")[0].as_py(), group.column("ny")[0].as_py()
        x, y = idx % nx, idx // nx % ny
        kept, shut = np.zeros(idx.size, bool), np.zeros(idx.size, bool)
        level = np.zeros(idx.size, np.int32)
        front = np.flatnonzero(group.column("seed").to_numpy().astype(bool)
                               & (hard | (soft & (hu <= p.ceiling(0)))))
        kept[front] = True
        cap, added, closed = int(p.leak_ratio * hard.sum()) + p.cap_base, 0, False
        recent, depth = Baseline(), 0
        while front.size:
            depth += 1
            steps = []
            for ok, move in ((x[front] < nx - 1, 1), (x[front] > 0, -1), (y[front] < ny - 1, nx),
                             (y[front] > 0, -nx), (True, nx * ny), (True, -nx * ny)):
                want = idx[front[ok]] + move if ok is not True else idx[front] + move
                spot = np.minimum(np.searchsorted(idx, want), idx.size - 1)
                steps.append(spot[idx[spot] == want])
            near = np.unique(np.concatenate(steps))
            near = near[~(kept | shut)[near]]
            relaxed = soft[near] & (hu[near] <= p.ceiling(depth)) & (not closed)
            layer = near[hard[near] | relaxed]
            if recent.explodes(layer.size, p):
                shut[layer[~hard[layer]]] = True
                layer = layer[hard[layer]]
            else:
                added += int((~hard[layer]).sum())
                closed = closed or added > cap
            kept[layer], level[layer] = True, depth
            recent.store(layer.size)
            front = layer
        rows = np.flatnonzero(kept)
        return group.take(pa.array(rows)).select([c for c in group.column_names if c not in
                                                  ("hu", "hard", "tubular", "seed")]) \
            .append_column("level", pa.array(level[rows], pa.int32()))
    return grow


def _opened(cells: DataFrame, p: WavefrontParams, keys: tuple[str, ...]) -> DataFrame:
    """The book of every key before its first layer; its rows are counted once, as their number never changes."""
    book = cut(cells.groupBy(*keys).agg(F.sum(F.col("hard").cast("long")).alias("_n")).select(
        *keys, ((F.lit(p.leak_ratio) * F.col("_n")).cast("long") + p.cap_base).alias("_cap"),
        F.lit(0).cast("long").alias("_added"), F.lit(False).alias("_closed"), F.lit(False).alias("_burst"),
        F.array().cast("array<double>").alias("_recent")))
    book._rows = book.count()
    return book


def _entered(book: DataFrame, layer: DataFrame, p: WavefrontParams, keys: tuple[str, ...]) -> DataFrame:
    """The books after a layer: one aggregate of the layer, joined by key.  ``_burst`` tells whose layer exploded."""
    sizes = layer.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col("hard").cast("long")).alias("_h"))
    kept, met = F.size("_recent"), F.col("_n").isNotNull()
    mean = F.when(kept > 0, F.aggregate("_recent", F.lit(0.0), lambda a, v: a + v) / kept).otherwise(F.lit(0.0))
    burst = F.coalesce((F.col("_n") > p.leak_base) & ((mean <= 0) | (F.col("_n") > p.leak_factor * mean)), F.lit(False))
    stored = F.array(F.when(F.col("_burst"), F.col("_h")).otherwise(F.col("_n")).cast("double"))
    added = F.col("_added") + F.when(met & ~F.col("_burst"), F.col("_n") - F.col("_h")).otherwise(F.lit(0))
    out = cut(book.join(sizes, list(keys), "left").withColumn("_burst", burst).withColumn("_added", added).select(
        *keys, "_cap", "_added",
        (F.col("_closed") | (met & ~F.col("_burst") & (F.col("_added") > F.col("_cap")))).alias("_closed"), "_burst",
        F.when(~met, F.col("_recent")).when(kept < SLOTS, F.concat("_recent", stored))
        .otherwise(F.concat(stored, F.slice("_recent", 2, SLOTS - 1))).alias("_recent")))
    out._rows = book._rows
    return out


def _grow_by_layers(cells: DataFrame, p: WavefrontParams, keys: tuple[str, ...]) -> DataFrame:
    """All keys in one loop; only the number of voxels of a layer reaches the driver."""
    cells = cut(cells)
    book = _opened(cells, p, keys)
    soft = F.col("tubular") & (F.col("hu") <= p.hu_abs_max)
    ident = [*keys, "idx"]
    front = cut(cells.where(F.col("seed") & (F.col("hard") | (soft & (F.col("hu") <= p.ceiling(0)))))
                .select(*ident, *DIMS))
    kept = front.select(*ident, *DIMS, F.lit(0).alias("level"))
    seen = front.select(*ident)
    depth, width = 0, front.count()
    nx, ny, plane = F.col("nx").cast("long"), F.col("ny"), F.col("nx").cast("long") * F.col("ny")
    x, y = F.col("idx") % nx, F.expr("(idx div nx) % ny")
    moves = F.array_compact(F.array(
        F.when(x < nx - 1, F.col("idx") + 1), F.when(x > 0, F.col("idx") - 1),
        F.when(y < ny - 1, F.col("idx") + nx), F.when(y > 0, F.col("idx") - nx),
        F.col("idx") + plane, F.col("idx") - plane))
    while True:
        depth += 1
        reach = front.select(*keys, F.explode(moves).alias("idx")).distinct()
        if 6 * width <= BROADCAST_ROWS:
            # A counted, small front goes to the voxels: both big frames are only scanned.
            reach = F.broadcast(reach)
        near = cells.join(reach, ident, "left_semi").join(seen.join(reach, ident, "left_semi"), ident, "left_anti")
        relaxed = soft & (F.col("hu") <= p.ceiling(depth)) & ~F.col("_closed")
        layer = cut(attach(near, book, list(keys)).where(F.col("hard") | relaxed).select(*ident, *DIMS, "hard"))
        width = layer.count()
        if not width:
            return kept
        book = _entered(book, layer, p, keys)
        seen = seen.unionByName(layer.select(*ident))
        front = attach(layer, book, list(keys)).where(F.col("hard") | ~F.col("_burst")).select(*ident, *DIMS)
        kept = kept.unionByName(front.withColumn("level", F.lit(depth)))
        if depth % 16 == 0:
            seen, kept = cut(seen), cut(kept)


def wavefront_grow(vox: DataFrame, seeds: DataFrame, p: WavefrontParams = WavefrontParams(),
                   keys: tuple[str, ...] = ("case_id",), task_voxels: int = TASK_VOXELS) -> DataFrame:
    """Grow from ``seeds`` over ``vox (keys, x, y, z, dims, hu, vness, hard, roi)``.

    Returns the kept voxels with the layer each was reached in.
    """
    open_ = eligible(vox, p, keys)
    start = seeds.select(*keys, "x", "y", "z").distinct()
    cells = open_.join(start.withColumn("seed", F.lit(True)), [*keys, "x", "y", "z"], "left")
    cells = cut(cells.select(*keys, *DIMS, "idx", "hu", "hard", "tubular", F.coalesce("seed", F.lit(False)).alias("seed")))
    sizes = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    sized = attach(cells, sizes, list(keys))
    schema = T.StructType([*[cells.schema[k] for k in keys], *[cells.schema[d] for d in DIMS],
                           cells.schema["idx"], T.StructField("level", T.IntegerType())])
    columns = [*keys, *DIMS, "idx", "hu", "hard", "tubular", "seed"]
    small = sized.where(F.col("_n") <= task_voxels).select(*columns)
    grown = small.groupBy(*keys).applyInArrow(_grow_in_task(p), schema)
    if not sizes.where(F.col("_n") > task_voxels).isEmpty():
        large = sized.where(F.col("_n") > task_voxels).select(*columns)
        grown = grown.unionByName(_grow_by_layers(large, p, keys).select(*schema.names))
    return with_decoded(grown).select(*keys, "x", "y", "z", *DIMS, "level")
