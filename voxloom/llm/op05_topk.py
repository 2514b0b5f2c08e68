"""Exact top-k inner products over vectors sorted by length.

Vectors are turned into integers, sorted by length (longest first) and packed into
blocks, which are numbered in that order.  A rotation, the right singular vectors of a
bounded sample, moves most of the length into the first components; each block keeps the
rotated head of its vectors and the length of the rest.

The first block gives each query a first k-th score.  By Cauchy-Schwarz a block whose
longest vector, times the query's length, stays below that score cannot help, and as the
blocks are sorted, a group of queries needs a prefix of them alone.  Inside a block the
head's product plus the product of the lengths of the rests bounds each score; only
candidates whose bound reaches the k-th score are multiplied out, in integers.

The rotation and the bounds only save work: every vector is indexed and results are
exact.  Products of integers stay below 2**53 in doubles, else Python integers are used.

Cases: vectors that are null or hold null or non-finite components take no part; shorter
vectors count as ending in zeros; rows repeating an id are rows of their own, each query
row against all other rows; null ids are never queries and lose ties; scores beyond the
long range are given as its ends; no vectors give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

#: Vectors of a block, queries of a group, rows that the rotation is fitted on, rotated components kept.
BLOCK_ROWS, GROUP_ROWS, SAMPLE_ROWS, HEAD = 4096, 512, 4096, 16
_NO_ID = np.iinfo(np.int64).max


def matrix(column: pa.Array, dims: int | None = None) -> np.ndarray:
    """Lists of doubles as rows, padded with zeros."""
    offsets = column.offsets.to_numpy()
    sizes, flat = np.diff(offsets), column.flatten().to_numpy(zero_copy_only=False)
    width = int(sizes.max()) if dims is None and len(sizes) else dims or 0
    out = np.zeros((len(sizes), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def whole_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of integers held in doubles."""
    most = np.abs(a).max(initial=0.0) * np.abs(b).max(initial=0.0) * a.shape[1]
    if most < 2.0 ** 53:
        return (a @ b.T).astype(np.int64)
    low, high = -(1 << 63), (1 << 63) - 1
    exact = np.array([[int(x) for x in r] for r in a], object) @ np.array([[int(x) for x in r] for r in b], object).T
    return np.array([[min(max(x, low), high) for x in r] for r in exact], np.int64).reshape(len(a), len(b))


def best(scores: np.ndarray, ids: np.ndarray, query: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of each query: highest score, then smallest id."""
    order = np.lexsort((ids, -scores, query))
    q = query[order]
    first = np.searchsorted(q, q, side="left")
    return order[np.arange(len(q)) - first < k]


def _pack(name: str, rows: int, dims: int, turn: np.ndarray, head: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def put(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(parts).combine_chunks()
            v = matrix(t["v"].chunk(0), dims)
            rotated = v @ turn[:, :head]
            full = np.sqrt(np.einsum("ij,ij->i", v, v))
            rest = np.sqrt(np.maximum(full ** 2 - np.einsum("ij,ij->i", rotated, rotated), 0))
            return pa.RecordBatch.from_pydict({
                f"{name}_longest": [float(full.max())], f"{name}_uids": [t["uid"].to_numpy().tobytes()],
                f"{name}_ids": [t["vec_id"].fill_null(_NO_ID).to_numpy().astype(np.int64).tobytes()], f"{name}_v": [v.tobytes()],
                f"{name}_head": [rotated.tobytes()], f"{name}_rest": [rest.tobytes()], f"{name}_length": [full.tobytes()]})
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


def _schema(name: str) -> str:
    return ", ".join([f"{name}_longest double", *[f"{name}_{c} binary" for c in ("uids", "ids", "v", "head", "rest", "length")]])


def _blocks(vectors: DataFrame, name: str, rows: int, dims: int, turn: np.ndarray, head: int, count: int) -> DataFrame:
    """Blocks numbered from the longest vectors on (``<name>_no``)."""
    n = max(1, -(-count // rows))
    ordered = vectors.repartitionByRange(n, F.desc("length"), "uid").sortWithinPartitions(F.desc("length"), "uid")
    packed = stash(ordered.mapInArrow(_pack(name, rows, dims, turn, head), _schema(name)), name)
    # One number a block of thousands of rows.
    numbered = stash(packed.select(f"{name}_uids", f"{name}_longest").select(
        F.xxhash64(f"{name}_uids").alias("_h"),
        (F.row_number().over(Window.orderBy(F.desc(f"{name}_longest"), f"{name}_uids")) - 1).alias(f"{name}_no")), "numbers")
    return stash(packed.withColumn("_h", F.xxhash64(f"{name}_uids")).join(numbered, "_h").drop("_h"), name)


def _doubles(data: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(data).reshape(rows, -1) if rows else np.zeros((0, 0))


def _search(k: int):
    """Best k of each query of a group in a block: uid, vec_id (null as the largest long), score."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                q_uids, c_uids = np.frombuffer(row["q_uids"], np.int64), np.frombuffer(row["c_uids"], np.int64)
                q_ids, c_ids = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["c_ids"], np.int64)
                nq, nc = len(q_uids), len(c_uids)
                floor = np.frombuffer(row["floor"]) if row["floor"] is not None else np.full(nq, -np.inf)
                q_length, c_length = np.frombuffer(row["q_length"]), np.frombuffer(row["c_length"])
                slack = 1e-9 * (1 + q_length[:, None] * c_length[None, :].max(initial=0.0))
                # Sorted by length: past the last candidate that may reach a query's score, nothing helps it.
                need = q_length[:, None] * c_length[None, :] + slack >= floor[:, None]
                reach = int(need.any(axis=0).nonzero()[0].max(initial=-1)) + 1
                bound = (_doubles(row["q_head"], nq) @ _doubles(row["c_head"], nc)[:reach].T
                         + np.frombuffer(row["q_rest"])[:, None] * np.frombuffer(row["c_rest"])[None, :reach] + slack)
                may = (bound >= floor[:, None]) & (q_uids[:, None] != c_uids[None, :reach])
                cols = np.flatnonzero(may.any(axis=0))
                scores = whole_products(_doubles(row["q_v"], nq), _doubles(row["c_v"], nc)[cols])
                q, c = np.nonzero(may[:, cols])
                s = scores[q, c]
                top = best(s, c_ids[cols][c], q, k)
                yield pa.RecordBatch.from_pydict({
                    "q_uid": q_uids[q[top]], "query_id": q_ids[q[top]], "vec_id": c_ids[cols][c[top]],
                    "c_uid": c_uids[cols][c[top]], "score": s[top]})
    return run


def _floors(k: int):
    """Put the first k-th scores of a group's queries beside the group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _search(k)
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                found = next(search(iter([one])))
                uids = np.frombuffer(one.column("q_uids")[0].as_py(), np.int64)
                place = {u: j for j, u in enumerate(uids.tolist())}
                at = np.array([place[u] for u in found.column("q_uid").to_pylist()], np.int64)
                score = found.column("score").to_numpy()
                floor, seen = np.full(len(uids), np.inf), np.bincount(at, minlength=len(uids))
                np.minimum.at(floor, at, score.astype(float))
                floor = np.where(seen >= k, np.nextafter(floor, -np.inf), -np.inf)
                length = np.frombuffer(one.column("q_length")[0].as_py())
                # Longest vector below which no query of the group can find more.
                with np.errstate(divide="ignore", invalid="ignore"):
                    need = np.where(floor <= 0, 0.0, floor / length).min(initial=np.inf) * (1 - 1e-9)
                yield pa.RecordBatch.from_pydict({"q_no": one.column("q_no"), "floor": [floor.tobytes()], "need": [float(need)]})
    return run


def search(vectors: DataFrame, every: int = 50, k: int = 5, scale: float = 256.0, block_rows: int = BLOCK_ROWS,
           group_rows: int = GROUP_ROWS, head: int = HEAD) -> DataFrame:
    """Queries are the rows whose id ``every`` divides: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    out = "query_id long, rank int, vec_id long, score long"
    x = F.col("embedding").cast("array<double>")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    turned = vectors.where(F.col("embedding").isNotNull() & sound).select(F.col("vec_id").cast("long"), x.alias("x"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("x")
            flat = np.clip(np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False)), -1e150, 1e150)
            offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            v = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))
            rows = matrix(v)
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id"), "v": v,
                                              "length": np.sqrt(np.einsum("ij,ij->i", rows, rows))})
    ready = stash(stash(turned.mapInArrow(whole, "vec_id long, v array<double>, length double"), "vectors")
                  .withColumn("uid", F.monotonically_increasing_id()), "vectors")
    count, dims = ready.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    asked = ready.where(F.col("vec_id") % every == 0)
    n_asked = asked.count()
    if not count or not n_asked:
        return spark.createDataFrame([], out)
    sample = ready.orderBy(F.xxhash64("uid")).limit(SAMPLE_ROWS).select("v").toArrow()
    seen = matrix(pa.concat_arrays(sample["v"].chunks), dims)
    turn = np.linalg.svd(np.ascontiguousarray(seen.T @ seen) / (np.abs(seen).max(initial=1.0) ** 2))[0] if dims else np.zeros((0, 0))
    head = min(head, dims)
    blocks = _blocks(ready, "c", block_rows, dims, turn, head, count)
    groups = _blocks(asked, "q", group_rows, dims, turn, head, n_asked)
    # One block of bounded size meets every group.
    opening = groups.withColumn("_k", F.lit(0)).join(
        F.broadcast(blocks.where("c_no = 0").withColumn("_k", F.lit(0))), "_k").withColumn("floor", F.lit(None).cast("binary"))
    floors = stash(opening.mapInArrow(_floors(k), "q_no int, floor binary, need double"), "floors")
    lengths = blocks.select("c_no", "c_longest")
    # Steps of the block lengths: at most 1024 of them, each with the blocks up to it.
    steps = max(1, blocks.count() // 1024)
    ladder = sorted((r["c_longest"], r["c_no"]) for r in lengths.where(F.col("c_no") % steps == 0).collect())
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ladder])
    last = F.aggregate(pairs, F.lit(0), lambda m, p: F.when(F.col("need") <= p["a"], F.greatest(m, p["b"] + steps - 1))
                       .otherwise(m))
    wanted = floors.select("q_no", "floor", F.explode(F.sequence(F.lit(0), last)).alias("c_no"))
    met = wanted.join(groups, "q_no").repartition("q_no", "c_no").join(blocks, "c_no")
    found = met.mapInArrow(_search(k), "q_uid long, query_id long, vec_id long, c_uid long, score long")
    order = Window.partitionBy("q_uid").orderBy(F.desc("score"), "vec_id", "c_uid")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", F.when(F.col("vec_id") != _NO_ID, F.col("vec_id")).alias("vec_id"), "score"))
