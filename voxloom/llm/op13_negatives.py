"""Hard negatives by exact inner products of packed integers.

Vectors become integers.  Rows, sorted by label, are packed into blocks, the anchors
into groups of the same kind.  Neighbouring groups make a part, and so do neighbouring
blocks; a part of groups and a part of blocks meet in a cell, which is one task's work:

* first where they share a label, for the best rows of an anchor's own label (its
  positives),
* then all of them, for the best rows of other labels whose scores lie in the band that a
  positive's score sets (its hard negatives).

A cell gets every group and block of its parts once, sorted, groups first; a task holds
the groups and takes the blocks one after another.  So no row a pair is formed, vectors
travel once a cell and are never broadcast: joins that carry them are hinted, as the
planner knows neither what an explode adds nor how far packed vectors are compressed.  A
task keeps the best of each group over all blocks that it sees, so what it gives does not
grow with the blocks.

Scores come from Kronecker-packed products.  Components are biased to be no less than
zero; as many candidates as fit stand in separate fields of one wide integer, a component
each, so that one multiplication by an anchor's component multiplies them all, and the
sum over the components holds their scores side by side.  Fields are as wide as the
largest possible sum, hence never run over; the biases are taken off when the fields are
unpacked.  Integers up to 53 bits are held in doubles, where sums and products of them are
exact; wider ones are Python integers that pack a whole block.

Cases: rows with a null label or vector, or a null or non-finite component take no part;
shorter vectors count as ending in zeros; rows repeating an id are rows of their own; null
ids are never anchors, lose ties and keep their label; scores beyond the long range are
given as its ends; anchors without positives, and positives whose band is empty, give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bring, settings, stash
from .op05_topk import _NO_ID, best, matrix

#: Rows of a block, anchors of a group, bits of a double, groups that a task keeps, candidates looked at together.
BLOCK_ROWS, GROUP_ROWS, DOUBLE_BITS, KEPT_GROUPS, CHUNK = 4096, 512, 53, 64, 500_000
#: Blocks of a cell, blocks that one sorted partition is cut into, tasks that cells are dealt to (more cells share them).
CELL_BLOCKS, SORTED_BLOCKS, CELL_TASKS = 16, 4, 2000
#: Packed rows reach Python so many bytes at a time; by Spark's own limit a batch takes 64 MB on either side.
BATCH_BYTES = 4 << 20
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def packed_products(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of integers held in doubles: anchors down, candidates across."""
    dims = a.shape[1]
    if not len(a) or not len(c) or not dims:
        return np.zeros((len(a), len(c)), np.int64)
    low_a, low_c = a.min(), c.min()
    spans = [max(1, int(x.max()) - int(low)) for x, low in ((a, low_a), (c, low_c))]
    bits = (spans[0] * spans[1] * dims).bit_length()       # a field holds any sum, and any component
    fields = DOUBLE_BITS // bits
    if fields < 2 or max(1.0, np.abs(a).max()) * max(1.0, np.abs(c).max()) * dims >= 2.0 ** DOUBLE_BITS:
        return _wide_products(a, c, bits)
    words = -(-len(c) // fields)
    packed = np.zeros((dims, words))
    for f in range(fields):
        part = (c[f * words:(f + 1) * words] - low_c).T
        packed[:, :part.shape[1]] += part * 2.0 ** (bits * f)
    sums = ((a - low_a) @ packed).astype(np.int64)
    mask = (1 << bits) - 1
    out = np.concatenate([(sums >> (bits * f)) & mask for f in range(fields)], axis=1)[:, :len(c)]
    return (out + (low_c * a.sum(axis=1)).astype(np.int64)[:, None] + (low_a * c.sum(axis=1)).astype(np.int64)[None, :]
            - int(low_a * low_c * dims))


def _wide_products(a: np.ndarray, c: np.ndarray, bits: int) -> np.ndarray:
    """The same with one Python integer a component that packs all candidates."""
    rows, others = [[int(x) for x in r] for r in a], [[int(x) for x in r] for r in c]
    low_a, low_c, dims = min(map(min, rows)), min(map(min, others)), a.shape[1]
    width = -(-bits // 8)
    packed = [int.from_bytes(b"".join((r[k] - low_c).to_bytes(width, "little") for r in others), "little") for k in range(dims)]
    added = [low_a * sum(r) - dims * low_a * low_c for r in others]
    out = np.empty((len(a), len(c)), np.int64)
    for i, r in enumerate(rows):
        total = sum((x - low_a) * w for x, w in zip(r, packed, strict=True)).to_bytes(width * len(others), "little")
        more = low_c * sum(r)
        out[i] = [min(max(int.from_bytes(total[j * width:(j + 1) * width], "little") + more + added[j], _LOW), _HIGH)
                  for j in range(len(others))]
    return out


def _narrow(v: np.ndarray) -> bytes:
    """Rows of integers held in doubles, in the fewest bytes that hold each of them."""
    for kind in (np.int16, np.int32):
        if not v.size or (v.min() >= np.iinfo(kind).min and v.max() <= np.iinfo(kind).max):
            return v.astype(kind).tobytes()
    return v.tobytes()


def _wide(data: bytes, rows: int, dims: int) -> np.ndarray:
    kind = {2: np.int16, 4: np.int32, 8: np.float64}[len(data) // (rows * dims) if rows * dims else 8]
    return np.frombuffer(data, kind).reshape(rows, dims).astype(np.float64)


def _pack(rows: int, dims: int):
    """Sorted rows put together: whole blocks of vectors, with the labels that they hold."""
    def put(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks()
        labels, uids = t["label"].to_numpy(), t["uid"].to_numpy()
        return pa.RecordBatch.from_pydict({
            "first": pa.array([int(uids[0])], pa.int64()), "low": pa.array([int(labels[0])], pa.int64()),
            "rows": pa.array([len(uids)], pa.int64()), "held": pa.array([np.unique(labels).tolist()], pa.list_(pa.int64())),
            "uids": [uids.tobytes()], "ids": [t["vec_id"].fill_null(_NO_ID).to_numpy().astype(np.int64).tobytes()],
            "labels": [labels.astype(np.int64).tobytes()], "v": [_narrow(matrix(t["v"].chunk(0), dims))]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            while batch.num_rows:
                room = rows - sum(b.num_rows for b in held)
                held.append(batch.slice(0, room))
                batch = batch.slice(room)
                if sum(b.num_rows for b in held) == rows:
                    yield put(held)
                    held = []
        if held:
            yield put(held)
    return run


_BLOCK = ("uids", "ids", "labels", "v")


def _blocks(vectors: DataFrame, name: str, rows: int, dims: int, count: int, part_rows: int) -> DataFrame:
    """Blocks of rows sorted by label, numbered (``no``); those that start within ``part_rows`` rows make a ``<name>_part``."""
    # The driver sorts a sample of 300 rows a partition to place them.
    n = max(1, -(-count // (SORTED_BLOCKS * rows)))
    packed = stash(vectors.repartitionByRange(n, "label", "uid").sortWithinPartitions("label", "uid").mapInArrow(
        _pack(rows, dims), "first long, low long, rows long, held array<long>, uids binary, ids binary, labels binary, v binary"), name)
    # A narrow row a block of thousands of rows.
    order = Window.orderBy("low", "first")
    before = F.coalesce(F.sum("rows").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbers = stash(packed.select("first", "low", "rows").select(
        "first", (F.row_number().over(order) - 1).alias("no"), F.floor(before / part_rows).cast("int").alias(f"{name}_part")), "numbers")
    return stash(bring(packed.drop("low", "rows").hint("merge"), numbers, ["first"]).drop("first"), name)


def _side(batch: pa.RecordBatch, i: int, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    uids, ids, labels = (np.frombuffer(batch.column(c)[i].as_py(), np.int64) for c in ("uids", "ids", "labels"))
    return uids, ids, labels, _wide(batch.column("v")[i].as_py(), len(uids), dims)


class _Best:
    """The k best of each question of the groups that a task meets: question, score, id and number of a row."""

    def __init__(self, k: int):
        self.k, self.held, self.waiting, self.rows = k, {}, {}, 0

    def add(self, group: int, ask: np.ndarray, score: np.ndarray, ids: np.ndarray, uids: np.ndarray) -> None:
        self.waiting.setdefault(group, []).append((ask, score, ids, uids))
        self.rows += len(ask)
        if self.rows > CHUNK:
            self._merge(*self.waiting)

    def _merge(self, *groups: int) -> None:
        for group in groups:
            parts = self.waiting.pop(group, None)
            if parts is None:
                continue
            self.rows -= sum(len(x[0]) for x in parts)
            if group in self.held:
                parts.insert(0, self.held[group])
            new = tuple(np.concatenate(x) for x in zip(*parts, strict=True))
            # best() keeps the order of rows that tie in score and id: put small numbers first.
            order = np.argsort(new[3], kind="stable")
            new = tuple(x[order] for x in new)
            top = best(new[1], new[2], new[0], self.k)
            self.held[group] = tuple(x[top] for x in new)

    def floor(self, group: int, ask: np.ndarray) -> np.ndarray:
        """Scores below which a row is none of the k best of a question: its k-th so far."""
        self._merge(group)
        out = np.full(len(ask), _LOW, np.int64)
        if group in self.held:
            asks, scores = self.held[group][:2]      # by question, best first
            last = np.searchsorted(asks, ask) + self.k - 1
            full = last < len(asks)
            full[full] = asks[last[full]] == ask[full]
            out[full] = scores[last[full]]
        return out

    def take(self) -> Iterator[pa.RecordBatch]:
        self._merge(*self.waiting)
        for group, (ask, score, ids, uids) in self.held.items():
            yield pa.RecordBatch.from_pydict({"q_no": np.full(len(ask), group, np.int32), "ask": ask, "score": score, "id": ids,
                                              "uid": uids})
        self.held.clear()


_FOUND = "q_no int, ask long, score long, id long, uid long"


def _cells(k: int, dims: int, asked, find):
    """Groups of a cell are held (``asked`` makes them ready), each of its blocks meets them in ``find``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, held, cell, part = _Best(k), [], None, None
        for batch in batches:
            for i in range(batch.num_rows):
                if batch.column("cell")[i].as_py() != cell:
                    held, cell = [], batch.column("cell")[i].as_py()
                if batch.column("q_part")[i].as_py() != part:
                    yield from kept.take()
                    part = batch.column("q_part")[i].as_py()
                side = _side(batch, i, dims)
                if batch.column("block")[i].as_py():
                    for group in held:
                        find(kept, group, side)
                else:
                    held.append((batch.column("no")[i].as_py(), asked(side, batch.column("asks").slice(i, 1))))
        yield from kept.take()
    return run


def _positives(k: int, dims: int):
    """Best rows of an anchor's own label; a question is the number of an anchor's row."""
    def find(kept: _Best, group: tuple, block: tuple) -> None:
        no, (q_uids, _, q_labels, q) = group
        c_uids, c_ids, c_labels, c = block
        rows, cols = np.isin(q_labels, c_labels), np.isin(c_labels, q_labels)
        if not rows.any():
            return
        q_uids, q_labels, c_uids, c_ids, c_labels = q_uids[rows], q_labels[rows], c_uids[cols], c_ids[cols], c_labels[cols]
        scores = packed_products(q[rows], c[cols])
        floor = kept.floor(no, q_uids)
        step = max(1, CHUNK // max(1, len(c_uids)))
        for a in range(0, len(q_uids), step):
            same = (q_labels[a:a + step, None] == c_labels[None, :]) & (q_uids[a:a + step, None] != c_uids[None, :])
            same &= scores[a:a + step] >= floor[a:a + step, None]
            x, y = np.nonzero(same)
            if len(x):
                kept.add(no, q_uids[a + x], scores[a + x, y], c_ids[y], c_uids[y])
    return _cells(k, dims, lambda side, _: side, find)


def _negatives(k: int, dims: int, low: int, high: int):
    """Best rows of other labels inside the band of each positive; a question is the number of a positive."""
    def asked(side: tuple, asks: pa.Array) -> tuple:
        q_uids, _, q_labels, q = side
        number, anchor, score = (asks.flatten().field(c).to_numpy() for c in ("ask", "anchor", "score"))
        place = np.argsort(q_uids)
        at = place[np.searchsorted(q_uids, anchor, sorter=place)]
        # whole scores n with low * p <= 100 * n <= high * p
        least = np.array([max(-(-low * x // 100), _LOW) for x in score.tolist()], np.int64)
        most = np.array([min(max(high * x // 100, _LOW), _HIGH) for x in score.tolist()], np.int64)
        rows, row_of = np.unique(at, return_inverse=True)
        return number, least, most, row_of, q_labels[at], q[rows]

    def find(kept: _Best, group: tuple, block: tuple) -> None:
        no, (number, least, most, row_of, labels, q) = group
        c_uids, c_ids, c_labels, c = block
        if (labels == labels[0]).all() and (c_labels == labels[0]).all():
            return
        scores = packed_products(q, c)
        floor = np.maximum(least, kept.floor(no, number))
        step = max(1, CHUNK // max(1, len(c_uids)))
        for a in range(0, len(number), step):
            s = scores[row_of[a:a + step]]
            fit = (s >= floor[a:a + step, None]) & (s <= most[a:a + step, None])
            fit &= labels[a:a + step, None] != c_labels[None, :]
            x, y = np.nonzero(fit)
            if len(x):
                kept.add(no, number[a + x], s[x, y], c_ids[y], c_uids[y])
    return _cells(k, dims, asked, find)


_ASKS = "array<struct<ask: bigint, anchor: bigint, score: bigint>>"


def _meet(groups: DataFrame, blocks: DataFrame, cells: DataFrame, run, parts: int, n_cells: int) -> DataFrame:
    """Rows that ``run`` finds in the cells (q_part, c_part): a task gets whole cells, the groups of each before its blocks."""
    cells = stash(cells.withColumn("cell", F.col("q_part") * parts + F.col("c_part")), "cells")
    count = cells.count()
    sides = [bring(side.hint("merge"), cells, [on], rows=count).select("cell", "q_part", F.lit(block).alias("block"), "no", *_BLOCK,
                                                                       asks.cast(_ASKS).alias("asks"))
             for side, on, block, asks in ((groups, "q_part", False, F.col("asks")), (blocks, "c_part", True, F.lit(None)))]
    tasks = min(n_cells, CELL_TASKS)
    return sides[0].unionByName(sides[1]).repartitionById(tasks, (F.col("cell") % tasks).cast("int")).sortWithinPartitions(
        "cell", "block", "no").mapInArrow(run, _FOUND)


def mine(vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
         scale: float = 256.0, block_rows: int = BLOCK_ROWS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Of rows vec_id, embedding, label: anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = vectors.sparkSession
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    x = F.col("embedding").cast("array<double>")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = F.transform(x, lambda v: F.greatest(F.lit(-1e150), F.least(F.lit(1e150), F.rint(v * scale)
                                                                    - (F.rint(v * scale) > v * scale).cast("double"))))
    ready = stash(stash(vectors.where(F.col("embedding").isNotNull() & sound & F.col("label").isNotNull()).select(
        F.col("vec_id").cast("long"), F.col("label").cast("long"), whole.alias("v")), "vectors")
        .withColumn("uid", F.monotonically_increasing_id()), "vectors")
    count, dims = ready.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    anchors = ready.where(F.col("vec_id") % every == 0)
    n_anchors = anchors.count()
    if not count or not n_anchors:
        return spark.createDataFrame([], out)
    q_rows = max(1, KEPT_GROUPS) * group_rows
    q_parts = -(-n_anchors // q_rows)
    # As many cells as the session has partitions in a shuffle, more if they grow too long.
    c_rows = min(CELL_BLOCKS * block_rows, max(block_rows, -(-count * q_parts // int(spark.conf.get("spark.sql.shuffle.partitions")))))
    c_parts = -(-count // c_rows)
    blocks, groups = _blocks(ready, "c", block_rows, dims, count, c_rows), _blocks(anchors, "q", group_rows, dims, n_anchors, q_rows)
    held = [side.select(f"{name}_part", F.explode("held").alias("label")).distinct() for side, name in ((groups, "q"), (blocks, "c"))]
    near = held[0].hint("merge").join(held[1], "label").select("q_part", "c_part").distinct()
    order = Window.partitionBy("ask").orderBy(F.desc("score"), "id", "uid")

    def first(met: DataFrame, k: int) -> DataFrame:
        return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    with settings(spark, {"spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)}):
        found = first(_meet(groups.withColumn("asks", F.lit(None)), blocks, near, _positives(positives, dims), c_parts,
                            q_parts * c_parts), positives)
        # Positives have numbers: the anchor's row has room for as many.
        asks = stash(found.select("q_no", F.col("ask").alias("anchor"), F.col("id").alias("positive_id"),
                                  F.col("score").alias("positive_score")).withColumn("ask", F.monotonically_increasing_id()), "positives")
        of_group = asks.groupBy(F.col("q_no").alias("no")).agg(
            F.collect_list(F.struct("ask", "anchor", F.col("positive_score").alias("score"))).alias("asks"))
        every_cell = groups.select("q_part").distinct().withColumn("c_part", F.explode(F.sequence(F.lit(0), F.lit(c_parts - 1))))
        best_of = stash(first(_meet(groups.hint("merge").join(of_group, "no"), blocks, every_cell,
                                    _negatives(negatives, dims, low, high), c_parts, q_parts * c_parts), negatives), "negatives")
    names = ready.select(F.col("uid").alias("anchor"), F.col("vec_id").alias("anchor_id")).where(F.col("vec_id") % every == 0)

    def id_of(c: str):
        return F.when(F.col(c) != _NO_ID, F.col(c))
    return (best_of.select("ask", "rank", id_of("id").alias("negative_id"), F.col("score").alias("negative_score"))
            .hint("merge").join(asks.drop("q_no"), "ask").hint("merge").join(names, "anchor")
            .select("anchor_id", id_of("positive_id").alias("positive_id"), "rank", "negative_id", "positive_score", "negative_score"))


def shifted_labels(vectors: DataFrame, every: int = 7, labels: int = 10) -> DataFrame:
    """Rows whose id ``every`` divides get the next label."""
    moved = (F.col("label") + 1) % labels
    return vectors.withColumn("label", F.when(F.col("vec_id") % every == 0, moved).otherwise(F.col("label")))
