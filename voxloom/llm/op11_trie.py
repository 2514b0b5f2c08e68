"""Prefix trie of rebuilt conversations, rolled up band by band.

Every conversation c starts with the first h turns of its base c - c % 5 (h from c's
checksum) and goes on with its own turns after its first h.  A node is a distinct
sequence of first turns; the conversations that start with it are its members.

* The five conversations of a base lie in one key, so one sort by base, conversation and
  turn lets a task rebuild them as a stream: it holds at most eight turns of the base and
  the digests of one band.  A node is named by a 128-bit chained digest of its turns.
* Totals over subtrees go up in bands of ``height`` depths.  Every node adds its figures to
  itself and its ancestors inside its own band: at most ``height`` rows a node.  Then,
  from the deepest band on, the completed totals of a band's roots are added to the
  ancestors in the band above: at most ``height`` rows a root, and a round a band.
* The ids that end at a node are put together in ranges of ids first, by many tasks even
  for one node; the digest of a node's list then streams over its ranges.

Cases: turns are ordered by number (null first), then role, then text; null roles and
texts are empty; rows that repeat a turn are turns of their own; rows without conv_id take
no part; a conversation left without turns is a member of the root; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash, whole

#: Depths of a band, turns that a base lends at most, conversations of a base.
HEIGHT, LENT, FAMILY = 32, 8, 5
#: Ids of a range that is put together before a node's list is hashed.
RANGE_IDS = 8192
#: Parents that may be broadcast: those with more children than one in so many nodes.
BUSY_PARENTS = 50_000
ROOT = bytes(16)


def lent(conv_id: int) -> int:
    """Turns that a conversation takes from its base."""
    return zlib.crc32(str(conv_id).encode()) % (LENT + 1)


def turn_digest(role: str, text: str) -> bytes:
    role_, text_ = role.encode(), text.encode()
    return hashlib.blake2b(len(role_).to_bytes(8, "little") + role_ + text_, digest_size=16).digest()


PATHS = "conv_id long, depth int, node binary, parent binary, n_bytes long, up array<binary>"


class _Paths:
    """Rows of the trie under construction."""

    def __init__(self, height: int):
        self.height = height
        self.rows: list[tuple] = []
        self.conv = None

    def start(self, conv: int) -> None:
        self.conv, self.depth, self.node, self.band = conv, 0, ROOT, [ROOT]
        self.rows.append((conv, 0, ROOT, None, 0, []))

    def push(self, digest: bytes, n_bytes: int) -> None:
        parent, self.node = self.node, hashlib.blake2b(self.node + digest, digest_size=16).digest()
        self.depth += 1
        self.rows.append((self.conv, self.depth, self.node, parent, n_bytes, self.band))
        # A band's root starts a list of its own; its row keeps the whole path through the band above.
        self.band = [self.node] if self.depth % self.height == 0 else [*self.band, self.node]

    def finish(self) -> None:
        """A row without depth says where the conversation ends."""
        if self.conv is not None:
            self.rows.append((self.conv, None, self.node, None, None, None))
        self.conv = None

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [[]] * 6
        self.rows = []
        types = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.binary()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                                          ["conv_id", "depth", "node", "parent", "n_bytes", "up"])


def _rebuild(height: int):
    """Sorted turns, the base of a family first: a row for each conversation and depth, and one for its end."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, base_now, heads, seen, own = _Paths(height), None, [], 0, 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("base", "conv_id", "role", "text")]
            for base, conv, role, text in zip(*columns, strict=True):
                if conv != paths.conv:
                    paths.finish()
                    if base != base_now:
                        base_now, heads = base, []
                    paths.start(conv)
                    seen, own = 0, 0 if conv == base else lent(conv)
                    for turn in heads[:own]:
                        paths.push(*turn)
                turn = turn_digest(role, text), len(text.encode())
                seen += 1
                if conv == base and len(heads) < LENT:
                    heads.append(turn)
                if seen > own:
                    paths.push(*turn)
                if len(paths.rows) >= 20_000:
                    yield paths.take()
        paths.finish()
        yield paths.take()
    return run


def rebuilt_paths(turns: DataFrame, height: int = HEIGHT) -> DataFrame:
    """Per conversation and depth its node, the node's parent and, in ``up``, the ancestors of its band (of a band's
    root: those of the band above)."""
    c = F.col("conv_id").cast("long")
    given = turns.where(F.col("conv_id").isNotNull()).select(
        (c - c % FAMILY).alias("base"), c.alias("conv_id"), F.col("turn").alias("_turn"), whole("role").alias("role"),
        whole("text").alias("text"))
    ordered = given.repartition("base").sortWithinPartitions(
        "base", F.col("conv_id") != F.col("base"), "conv_id", F.asc_nulls_first("_turn"), "role", "text")
    return ordered.select("base", "conv_id", "role", "text").mapInArrow(_rebuild(height), PATHS)


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (node, conv_id): runs of up to RANGE_IDS ids of a node as text."""
    for batch in batches:
        node, ids = batch.column("node"), batch.column("conv_id").to_numpy()
        if not len(ids):
            continue
        keys = np.array(node.to_pylist(), "S16")         # trailing zeros are cut alike in all
        cuts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        cuts = np.unique(np.concatenate((cuts, np.arange(0, len(ids), RANGE_IDS))))
        stops = np.append(cuts[1:], len(ids))
        names = list(map(str, ids.tolist()))
        yield pa.RecordBatch.from_arrays(
            [node.take(pa.array(cuts)), pa.array(ids[cuts]),
             pa.array([",".join(names[a:b]) for a, b in zip(cuts.tolist(), stops.tolist(), strict=True)])],
            ["node", "first", "ids"])


def _hash_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges sorted by node and first id: the digest of each node's whole list."""
    now, made, nodes, digests = None, None, [], []
    for batch in batches:
        for node, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if node == now:
                made.update(b"," + ids.encode())
                continue
            if made:
                nodes.append(now)
                digests.append(made.hexdigest())
            now, made = node, hashlib.sha256(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(digests, pa.string())], ["node", "ends_sha256"])
        nodes, digests = [], []
    if made:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([made.hexdigest()])], ["node", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """(node, conv_id) -> (node, ends_sha256); ids ascending, joined by commas."""
    ranges = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(
        _ranges, "node binary, first long, ids string")
    return ranges.repartition("node").sortWithinPartitions("node", "first").select("node", "ids").mapInArrow(
        _hash_ranges, "node binary, ends_sha256 string")


def roll_up(nodes: DataFrame, values: list[str], height: int = HEIGHT) -> DataFrame:
    """Sums of ``values`` over each node's subtree: (node, …).

    ``nodes`` has node, depth, up and the values; rounds are as many as there are bands below the first.
    """
    sums = [F.sum(v).alias(v) for v in values]
    at_root = F.col("depth") % height == 0
    inside = F.when(at_root, F.array("node")).otherwise(F.concat("up", F.array("node")))
    own = stash(nodes.select(F.explode(inside).alias("node"), *values).groupBy("node").agg(*sums), "bands")
    roots = nodes.where(at_root & (F.col("depth") > 0)).select("node", "depth", "up")
    deepest = roots.agg(F.max("depth")).first()[0]
    if deepest is None:
        return own
    roots = stash(roots.join(own, "node"), "roots")
    given, parts = None, [own]
    for depth in range(deepest, 0, -height):
        level = roots.where(F.col("depth") == depth)
        if given is not None:
            more = given.select("node", *[F.col(v).alias(f"_{v}") for v in values])
            level = level.join(more, "node", "left").select(
                "node", "up", *[(F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values])
        given = stash(level.select(F.explode("up").alias("node"), *values).groupBy("node").agg(*sums), "band")
        parts.append(given)
    whole_ = parts[0]
    for p in parts[1:]:
        whole_ = whole_.unionByName(p)
    return whole_.groupBy("node").agg(*sums)


def _with_parents(nodes: DataFrame, count: int) -> DataFrame:
    """Add parent_conv_id; parents of very many children are few and go by broadcast, the others by a join."""
    named = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    most = max(10_000, count // BUSY_PARENTS)                # so at most BUSY_PARENTS parents have more children
    busy = stash(named.where(F.col("n_children") > most).drop("n_children"), "busy")
    marked = nodes.join(F.broadcast(busy.withColumnRenamed("parent_conv_id", "_busy")), "parent", "left")
    known = marked.where(F.col("_busy").isNotNull() | F.col("parent").isNull()).withColumnRenamed("_busy", "parent_conv_id")
    other = marked.where(F.col("_busy").isNull() & F.col("parent").isNotNull()).drop("_busy")
    return known.unionByName(other.join(named.where(F.col("n_children") <= most).drop("n_children"), "parent"))


def trie(turns: DataFrame, height: int = HEIGHT) -> DataFrame:
    """One row a node: node (its digest), conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256."""
    paths = stash(rebuilt_paths(turns, height), "paths")
    of_node = paths.where("depth is not null").groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.first("depth").alias("depth"),
        F.first("parent").alias("parent"), F.first("n_bytes").alias("n_bytes"), F.first("up").alias("up"))
    of_node = stash(of_node, "nodes")
    children = of_node.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = stash(of_node.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
                  .withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("n_bytes"))
                  .withColumn("n_leaves", (F.col("n_children") == 0).cast("long")), "nodes")
    totals = roll_up(nodes.select("node", "depth", "up", "n_leaves", "saved_tokens"), ["n_leaves", "saved_tokens"], height)
    ends = end_digests(paths.where("depth is null").select("node", "conv_id"))
    named = _with_parents(nodes.select("node", "parent", "conv_id", "depth", "n_convs", "n_children"), nodes.count())
    none = hashlib.sha256(b"").hexdigest()
    return named.join(totals, "node").join(ends, "node", "left").select(
        "node", "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves",
        "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def trie_report(turns: DataFrame, height: int = HEIGHT) -> DataFrame:
    """Per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    return trie(turns, height).drop("node")
