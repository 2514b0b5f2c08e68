"""Near copies: all documents whose word shingles have a Jaccard similarity over a bound.

A grouped prefix join.  Shingles are put in one order for all documents, rarest first,
and only the first n - ceil(bound * n) + 1 of a document's n shingles (its prefix) can
hold the first one it shares with a near copy.

* Documents with equal sets form one class, so copies are never paired; classes with the
  same prefix and size form a group that goes through the join of prefix shingles as one.
* The order takes counts from a table of 2**20 hash cells over all documents: of bounded
  size and broadcast.  Any order is right; this one keeps passages that many documents
  share out of the prefixes.
* Members that share a prefix shingle meet in a bucket.  Buckets of many members or many
  shingles are cut into parts which meet two by two.  Sizes, positions and parity sketches
  (a lower bound of the difference of two sets) are filters that lose nothing; pairs that
  pass are not given but joined to trees, an edge a member at most.
* The trees of all buckets make families.  Two similar documents are always of one family,
  so only families fetch whole sets, each once, and verify their pairs; large families are
  cut into parts which meet two by two.  A task gives one row a member: the documents
  linked to it there, and a root of a spanning forest of its links.  So rows and shuffle
  grow with members, buckets and parts, never with pairs, and no link is lost.
* A document's number of links is the sum of the sizes of the classes linked to its own,
  and the other rows of its own.

Shingles are 64-bit hashes.  Cases: null texts and texts without words have no shingles
and stay alone; fewer words than a shingle are one shingle; equal texts share a
component; null ids count only where a component has no other; rows that repeat an id
stay rows; no rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bring, buffers, folded, mixed, ragged, slices, stash, stretch_hashes, word_bounds
from .links import components
from .op06_exact import AT, located

CELL_BITS = 20
#: Members and shingles of a part of a bucket or family; rows of a comparison; shingles that a task verifies at once.
PART_ROWS, PART_SHINGLES, TILE_ROWS, HELD_SHINGLES = 4096, 4_000_000, 512, 2_000_000
#: Buckets and families under so many members are compared many at a time.
SMALL_ROWS = 48
#: Classes whose numbers may be broadcast to fetch their texts.
FETCH_ROWS = 100_000


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    raw = folded(raw)
    starts, stops, count = word_bounds(raw, offsets)
    token = stretch_hashes(raw, starts, stops)
    run = token.copy()
    short = [run]
    for i in range(1, words):
        longer = run[:max(0, len(token) - i)] if i == 1 else run[:max(0, len(run) - 1)]
        run = mixed(longer * np.uint64(3) + token[i:i + len(longer)] + np.uint64(i))
        short.append(run)
    first = np.cumsum(count) - count
    out = []
    for f, n in zip(first.tolist(), count.tolist(), strict=True):
        if n >= words:
            out.append(np.unique(short[-1][f:f + n - words + 1]))
        else:
            out.append(short[n - 1][f:f + 1] if n else token[:0])
    return out


def _cells(words: int, bits: int):
    """Counts of distinct shingles per hash cell, in chunks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            raw, offsets = buffers(batch.column("text"))
            for a, b in slices(offsets):
                sets = shingle_sets(raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], words)
                total += np.bincount((np.concatenate(sets) >> np.uint64(64 - bits)).astype(np.int64),
                                     minlength=1 << bits).astype(np.uint32)
        for i, chunk in enumerate(np.split(total, 64)):
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([i], pa.int32()), "counts": [chunk.tobytes()]})
    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, data in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            sums[chunk] = sums.get(chunk, 0) + np.frombuffer(data, np.uint32).astype(np.uint64)
    for chunk, counts in sums.items():
        yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int32()),
                                          "counts": [np.minimum(counts, 2 ** 32 - 1).astype(np.uint32).tobytes()]})


def cell_counts(docs: DataFrame, words: int, bits: int = CELL_BITS) -> np.ndarray:
    """The table of cells, 4 bytes each: its size does not depend on the documents."""
    rows = (docs.select("text").mapInArrow(_cells(words, bits), "chunk int, counts binary")
            .repartition(64, "chunk").mapInArrow(_add_up, "chunk int, counts binary").collect())
    total = np.zeros(1 << bits, np.uint32)
    for r in rows:
        width = (1 << bits) // 64
        total[r["chunk"] * width:(r["chunk"] + 1) * width] = np.frombuffer(r["counts"], np.uint32)
    return total


def sketch(shingles: np.ndarray) -> bytes:
    """Parities of 512 bits, doubled with the size; sketches fold onto shorter ones by XOR of their halves."""
    bits = 512
    while bits < len(shingles) // 2:
        bits *= 2
    return np.packbits(np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1,
                       bitorder="little").tobytes()


def _digest(shingles: np.ndarray) -> np.ndarray:
    return np.frombuffer(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest(), np.int64)


def _signatures(words: int, num: int, den: int, cells, bits: int, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.frombuffer(cells.value, np.uint32)
        for batch in batches:
            raw, offsets = buffers(batch.column("text"))
            for a, b in slices(offsets):
                sets = shingle_sets(raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], words)
                n, one, two, prefixes, sketches = [], [], [], [], []
                for s in sets:
                    digest = _digest(s)
                    length = len(s) + (num * len(s)) // -den + 1 if len(s) else 0
                    n.append(len(s))
                    one.append(digest[0])
                    two.append(digest[1])
                    prefixes.append(_ordered(s, counts, bits)[:length].view(np.int64))
                    sketches.append(sketch(s))
                lists = _list_array(prefixes)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in keep], pa.array(n, pa.int32()), pa.array(one, pa.int64()),
                     pa.array(two, pa.int64()), lists, pa.array(sketches, pa.binary())],
                    [*keep, "n", "d1", "d2", "prefix", "sketch"])
    return run


def _fit(num: int, den: int, n: np.ndarray, m: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether sets of n and m shingles that share those at positions i and j can be similar enough, by size and position."""
    sizes = den * np.minimum(n, m) >= num * np.maximum(n, m)
    least = -(-num * (n + m) // (num + den))
    return sizes & (np.minimum(i, j) + np.minimum(n - i, m - j) >= least)


def _lags(key: np.ndarray, wanted: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places with equal keys, one distance after another, where keys are sorted and the rows wanted."""
    for lag in range(1, SMALL_ROWS):
        i = np.flatnonzero((key[lag:] == key[:-lag]) & wanted[lag:])
        if not len(i):
            return
        yield i, i + lag


def _bounds(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of stretches of equal keys."""
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return first, np.diff(np.append(first, len(key)))


def _meeting(num: int, den: int):
    """Rows sorted by shingle: those whose shingle a group shares that may fit, with the number of parts of the bucket.

    A group of several classes (``many``) meets itself on its first shingle.
    """
    names = ("token", "gid", "pos", "n", "many")

    def out(token, gid, pos, n, many):
        first, size = _bounds(token)
        per_row = np.repeat(size, size)
        keep = (per_row >= SMALL_ROWS) | ((many > 1) & (pos == 0))
        for i, j in _lags(token, per_row < SMALL_ROWS):
            fit = _fit(num, den, n[i], n[j], pos[i], pos[j])
            keep[i[fit]] = keep[j[fit]] = True
        if not keep.any():
            return
        parts = np.maximum(-(-np.add.reduceat(many * keep, first) // PART_ROWS),
                           -(-np.add.reduceat(many * n * keep, first) // PART_SHINGLES))
        row = np.flatnonzero(keep)
        yield pa.RecordBatch.from_pydict({
            "token": token[row], "gid": gid[row], "pos": pos[row].astype(np.int32),
            "parts": np.maximum(np.repeat(parts, size)[row], 1).astype(np.int32)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {c: np.zeros(0, np.int64) for c in names}
        for batch in batches:
            held = {c: np.concatenate((held[c], batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64))) for c in names}
            token = held["token"]
            if len(token) and token[0] != token[-1]:
                cut = int(np.searchsorted(token, token[-1]))
                yield from out(*(held[c][:cut] for c in names))
                held = {c: held[c][cut:] for c in names}
        if len(held["token"]):
            yield from out(*held.values())
    return run


def _fold(sketches: list[bytes], words: int) -> np.ndarray:
    out = np.empty((len(sketches), words), np.uint64)
    for i, s in enumerate(sketches):
        x = np.frombuffer(s, np.uint64)
        while len(x) > words:
            x = x[:len(x) // 2] ^ x[len(x) // 2:]
        out[i] = x
    return out


def _fold8(sketches: pa.Array) -> np.ndarray:
    """All sketches folded to 512 bits."""
    if isinstance(sketches, pa.ChunkedArray):
        sketches = pa.concat_arrays(sketches.chunks)
    sizes = np.diff(np.frombuffer(sketches.buffers()[1], np.int32)[sketches.offset:sketches.offset + len(sketches) + 1])
    if (sizes == 64).all():
        at = np.frombuffer(sketches.buffers()[1], np.int32)[sketches.offset]
        return np.frombuffer(sketches.buffers()[2], np.uint64, count=8 * len(sketches), offset=int(at)).reshape(-1, 8)
    return _fold(sketches.to_pylist(), 8)


class Lists:
    """Lists of distinct values; how many values two of them share."""

    def __init__(self, values: np.ndarray, sizes: np.ndarray):
        known, self.item = np.unique(values, return_inverse=True)
        self.kinds, self.sizes = max(1, len(known)), sizes
        self.at = np.cumsum(sizes) - sizes
        self.codes = np.sort(np.repeat(np.arange(len(sizes)), sizes) * self.kinds + self.item)

    def _single(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Each value of the shorter list is looked up among those of the longer."""
        swap = self.sizes[i] > self.sizes[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        out = np.zeros(len(i), np.int64)
        ends = np.cumsum(self.sizes[i])
        a = 0
        while a < len(i) and len(self.codes):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + 1_000_000, side="right")))
            size = self.sizes[i[a:b]]
            wanted = np.repeat(j[a:b], size) * self.kinds + self.item[ragged(self.at[i[a:b]], size)]
            place = np.minimum(np.searchsorted(self.codes, wanted), len(self.codes) - 1)
            hits = np.concatenate(([0], np.cumsum(self.codes[place] == wanted)))
            stop = np.cumsum(size)
            out[a:b] = hits[stop] - hits[stop - size]
            a = b
        return out

    def _table(self, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """All rows against all columns: products of 0/1 tables of the values that both sides have."""
        sides = []
        for lists in (rows, cols):
            items = self.item[ragged(self.at[lists], self.sizes[lists])]
            sides.append((np.repeat(np.arange(len(lists)), self.sizes[lists]), items))
        has = [np.bincount(items, minlength=self.kinds) > 0 for _, items in sides]
        shared = np.flatnonzero(has[0] & has[1])
        number = np.full(self.kinds, -1, np.int64)
        number[shared] = np.arange(len(shared))
        entries = []
        for owner, items in sides:
            place = number[items]
            order = np.argsort(place, kind="stable")
            order = order[np.searchsorted(place[order], 0):]
            entries.append((owner[order], place[order]))
        out = np.zeros((len(rows), len(cols)), np.float32)
        for a in range(0, len(shared), 4096):
            width = min(4096, len(shared) - a)
            tables = []
            for (owner, place), lists in zip(entries, (rows, cols), strict=True):
                p, q = np.searchsorted(place, (a, a + width))
                t = np.zeros((len(lists), width), np.float32)
                t[owner[p:q], place[p:q] - a] = 1
                tables.append(t)
            out += tables[0] @ tables[1].T
        return out

    def shared(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of values that lists i and j share, pair by pair."""
        if len(i) >= 2048:
            rows, a = np.unique(i, return_inverse=True)
            cols, b = np.unique(j, return_inverse=True)
            if max(len(rows), len(cols)) <= TILE_ROWS and 8 * len(i) >= len(rows) * len(cols):
                return np.rint(self._table(rows, cols)[a, b]).astype(np.int64)
        return self._single(i, j)


def _longs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a column of lists of longs, one list after another, and the length of each."""
    offsets = column.offsets.to_numpy()
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.diff(offsets).astype(np.int64)


def _couples(t: dict[str, np.ndarray], num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of the same bucket, sorted by size, that fit by part, size and position."""
    first, size = _bounds(t["key"])
    per_row = np.repeat(size, size)

    def may(i, j):
        ok = (t["sid"][i] != t["sid"][j]) & ((t["low"][i] == t["high"][i]) | (t["part"][i] != t["part"][j]))
        i, j = i[ok], j[ok]
        ok = _fit(num, den, t["n"][i], t["n"][j], t["pos"][i], t["pos"][j])
        return i[ok], j[ok]
    for i, j in _lags(t["key"], per_row < SMALL_ROWS):
        yield may(i, j)
    for f, m in zip(first[size >= SMALL_ROWS].tolist(), size[size >= SMALL_ROWS].tolist(), strict=True):
        for a in range(f, f + m, TILE_ROWS):
            rows = np.arange(a, min(a + TILE_ROWS, f + m))
            for b in range(a, f + m, TILE_ROWS):
                cols = np.arange(b, min(b + TILE_ROWS, f + m))
                if den * t["n"][rows[-1]] < num * t["n"][cols[0]]:    # sorted by size: no later tile fits either
                    break
                i, j = np.repeat(rows, len(cols)), np.tile(cols, len(rows))
                upper = i < j
                yield may(i[upper], j[upper])


def _whole_buckets(batches: Iterator[pa.RecordBatch], names: tuple[str, ...], enough) -> Iterator[tuple[dict, pa.Table]]:
    """Sorted batches put together to whole buckets: long columns as arrays, with ``key`` numbering the buckets.

    The first three names tell the bucket.  A row that repeats a class within its bucket is dropped.
    """
    held: list[pa.RecordBatch] = []

    def arrays(table: pa.Table) -> dict[str, np.ndarray]:
        t = {c: table[c].to_numpy().astype(np.int64) for c in names}
        change = np.zeros(len(table), bool)
        for c in names[:3]:
            change[1:] |= t[c][1:] != t[c][:-1]
        t["key"] = np.cumsum(change)
        return t

    def sound(t: dict[str, np.ndarray], table: pa.Table):
        again = np.zeros(len(table), bool)
        again[1:] = (t["key"][1:] == t["key"][:-1]) & (t["sid"][1:] == t["sid"][:-1])
        if again.any():
            t, table = {c: x[~again] for c, x in t.items()}, table.filter(pa.array(~again)).combine_chunks()
        return t, table
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if not enough(held):
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        t = arrays(table)
        cut = int(np.searchsorted(t["key"], t["key"][-1]))
        if cut:
            yield sound({c: x[:cut] for c, x in t.items()}, table.slice(0, cut).combine_chunks())
            held = table.slice(cut).to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield sound(arrays(table), table)


def _relatives(num: int, den: int):
    """Rows of buckets: links (u, v) of a spanning forest of the pairs that pass by size, position and sketch."""
    names = ("token", "low", "high", "part", "pos", "sid", "n")

    def apart(t, sketches, folded8, i, j) -> tuple[np.ndarray, np.ndarray]:
        """Of the pairs (i, j), those whose sketches differ in few enough bits."""
        n, m = t["n"][i], t["n"][j]
        most = n + m - 2 * -(-num * (n + m) // (num + den))
        d = np.bitwise_count(folded8[i] ^ folded8[j]).sum(axis=1).astype(np.int64)
        near = d <= most
        i, j, d, most = i[near], j[near], d[near], most[near]
        for k in np.flatnonzero((t["n"][i] > 1024) & (t["n"][j] > 1024)).tolist():
            x, y = sketches[i[k]].as_py(), sketches[j[k]].as_py()
            width = min(len(x), len(y)) // 8
            d[k] = np.bitwise_count(_fold([x], width) ^ _fold([y], width)).sum()
        near = d <= most
        return i[near], j[near]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, table in _whole_buckets(batches, names, lambda held: sum(b.num_rows for b in held) >= 20_000):
            sketches = table["sketch"].chunk(0)
            folded8 = _fold8(sketches)
            sids, of = np.unique(t["sid"], return_inverse=True)
            root = np.arange(len(sids))
            for i, j in _couples(t, num, den):
                new = root[of[i]] != root[of[j]]
                i, j = apart(t, sketches, folded8, i[new], j[new])
                root = _forest(root, of[i], of[j])
            low = np.flatnonzero(root != np.arange(len(root)))
            yield pa.RecordBatch.from_pydict({"u": sids[low], "v": sids[root[low]]})
    return run


def _forest(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Roots (smallest numbers) of the trees after links i-j are added."""
    while True:
        a, b = root[i], root[j]
        open_ = a != b
        if not open_.any():
            return root
        i, j = i[open_], j[open_]
        np.minimum.at(root, np.maximum(a, b)[open_], np.minimum(a, b)[open_])
        while (root[root] != root).any():
            root = root[root]


def _verified(num: int, den: int):
    """Rows of families with whole sets: per member the rows linked to it here, and a member that its links lead to."""
    names = ("family", "low", "high", "part", "sid", "n", "copies")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def enough(held: list[pa.RecordBatch]) -> bool:
            return sum(len(b.column("shingles").flatten()) for b in held) >= HELD_SHINGLES
        for t, table in _whole_buckets(batches, names, enough):
            sets = Lists(*_longs(table["shingles"].chunk(0)))
            t["pos"] = np.zeros(len(table), np.int64)
            linked, root = np.zeros(len(table), np.int64), np.arange(len(table))
            for i, j in _couples(t, num, den):
                both = sets.shared(i, j)
                ok = den * both >= num * (t["n"][i] + t["n"][j] - both)
                i, j = i[ok], j[ok]
                np.add.at(linked, i, t["copies"][j])
                np.add.at(linked, j, t["copies"][i])
                root = _forest(root, i, j)
            row = np.flatnonzero(linked)
            yield pa.RecordBatch.from_pydict({"u": t["sid"][row], "linked": linked[row], "v": t["sid"][root[row]]})
    return run


def _sets(words: int):
    """Whole sets of the texts that are those of their class."""
    given = ["family", "parts", "sid", "copies"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = buffers(batch.column("text"))
            wanted = np.stack([batch.column(c).to_numpy() for c in ("d1", "d2")], axis=1)
            for a, b in slices(offsets):
                rows, lists = [], []
                for k, s in enumerate(shingle_sets(raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], words), a):
                    if (_digest(s) == wanted[k]).all():
                        rows.append(k)
                        lists.append(s.view(np.int64))
                part = batch.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in given], _list_array(lists)], [*given, "shingles"])
    return run


def _ordered(shingles: np.ndarray, counts: np.ndarray, bits: int) -> np.ndarray:
    """Rarest first."""
    return shingles[np.lexsort((shingles, counts[(shingles >> np.uint64(64 - bits)).astype(np.int64)]))]


def _list_array(lists: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)),
                                    pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int64)))


def link(rows: DataFrame, words: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """Of located rows: _file, _row, doc_id, n_shingles, root (a number of the component, null without shingles),
    component_id, n_links (the number of other rows that are similar enough)."""
    spark = rows.sparkSession
    cells = spark.sparkContext.broadcast(cell_counts(rows, words).tobytes())
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("long"))
    keep = ["doc_id", *AT]
    marks = stash(rows.select(*keep, "text").mapInArrow(
        _signatures(words, num, den, cells, CELL_BITS, keep),
        "doc_id long, _file string, _row long, n int, d1 long, d2 long, prefix array<long>, sketch binary"), "marks")
    spot = F.xxhash64(*AT)
    classes = stash(marks.where("n > 0").groupBy("d1", "d2", "n").agg(
        F.min("doc_id").alias("first_id"), F.min(spot).alias("spot"), F.first("prefix").alias("prefix"),
        F.first("sketch").alias("sketch"), F.count(F.lit(1)).alias("copies"))
        .withColumn("sid", F.monotonically_increasing_id()), "classes")
    # Classes of one prefix and size are one group; its first class stands in the join for all.
    keyed = classes.select("sid", "n", F.xxhash64("prefix").alias("_p"), F.hash("prefix").alias("_q"))
    grouped = keyed.groupBy("n", "_p", "_q").agg(F.min("sid").alias("gid"), F.count(F.lit(1)).alias("members"))
    shared = stash(grouped.where("members > 1"), "groups")
    n_shared = shared.count()
    inside = stash(bring(keyed, shared, ["n", "_p", "_q"], rows=n_shared).select("sid", "gid"), "members")
    n_inside = inside.count()
    others = inside.where("sid <> gid").select("sid")
    heads = bring(bring(classes.select("sid", "n", "prefix"), others, ["sid"], "left_anti", n_inside),
                  shared.select(F.col("gid").alias("sid"), F.col("members").alias("many")), ["sid"], "left", n_shared)
    tokens = heads.select(F.col("sid").alias("gid"), "n", F.coalesce("many", F.lit(1)).alias("many"),
                          F.posexplode("prefix").alias("pos", "token"))
    met = tokens.repartition("token").sortWithinPartitions("token").mapInArrow(
        _meeting(num, den), "token long, gid long, pos int, parts int")
    # Groups are opened before a bucket is cut into parts; each part meets each part.
    part = F.pmod(F.xxhash64("sid"), "parts").cast("int")
    spread = bring(met, inside.withColumnRenamed("sid", "_member"), ["gid"], "left", n_inside).withColumn(
        "sid", F.coalesce("_member", "gid")).withColumn("part", part).withColumn(
        "_other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "token", F.least("part", "_other").alias("low"), F.greatest("part", "_other").alias("high"), "part", "pos", "sid")
    bucket = ["token", "low", "high"]
    meeting = spread.join(classes.select("sid", "n", "sketch"), "sid").select(*bucket, "part", "pos", "sid", "n", "sketch")
    related = meeting.repartition(*bucket).sortWithinPartitions(*bucket, "n", "sid").mapInArrow(_relatives(num, den), "u long, v long")
    families = stash(components(related), "families").join(classes.select(F.col("sid").alias("id"), "n", "copies", "d1", "d2", "spot"), "id")
    size = families.groupBy(F.col("root").alias("family")).agg(F.greatest(
        F.lit(1), F.ceil(F.count(F.lit(1)) / PART_ROWS), F.ceil(F.sum("n") / PART_SHINGLES)).cast("int").alias("parts"))
    asked = stash(families.withColumnRenamed("root", "family").join(size, "family").select(
        "family", "parts", F.col("id").alias("sid"), "copies", "d1", "d2", "spot"), "asked")
    small = asked.count() <= FETCH_ROWS
    fetched = rows.select(spot.alias("spot"), "text").join(F.broadcast(asked) if small else asked, "spot").select(
        "family", "parts", "sid", "copies", "d1", "d2", "text")
    sets = fetched.mapInArrow(_sets(words), "family long, parts int, sid long, copies long, shingles array<long>")
    pieces = sets.withColumn("part", part).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "family", F.least("part", "_other").alias("low"), F.greatest("part", "_other").alias("high"), "part", "sid",
        F.size("shingles").alias("n"), "copies", "shingles")
    family = ["family", "low", "high"]
    found = stash(pieces.repartition(*family).sortWithinPartitions(*family, "n", "sid")
                  .mapInArrow(_verified(num, den), "u long, linked long, v long"), "links")
    roots = stash(components(found.select("u", "v")), "roots")
    linked = found.groupBy(F.col("u").alias("sid")).agg(F.sum("linked").alias("_linked"))
    of_class = classes.select("sid", "d1", "d2", "n", "first_id", "copies").join(
        roots.withColumnRenamed("id", "sid"), "sid", "left").join(linked, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    names = of_class.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = of_class.join(names, "root").select(
        "d1", "d2", "n", "component_id", "root", (F.coalesce("_linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    done = marks.select(*keep, "n", "d1", "d2").join(named, ["d1", "d2", "n"], "left")
    return done.select(*AT, "doc_id", F.col("n").cast("long").alias("n_shingles"), "root",
                       F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
                       F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def near_report(docs: DataFrame, words: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, n_links (other rows that are similar enough)."""
    return link(located(docs), words, num, den).select("doc_id", "n_shingles", "component_id", "n_links")


def keep_one(docs: DataFrame, words: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the row of the smallest id stays."""
    rows = located(docs)
    linked = stash(link(rows, words, num, den), "linked")
    first = linked.where("root is not null").groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("_none"), "doc_id", *AT)).alias("_s"))
    stay = first.select("_s._file", "_s._row").unionByName(linked.where("root is null").select(*AT))
    kept = rows.join(stay, AT, "left_semi")
    names = [c for c in kept.columns if c not in AT]
    return kept.select(*[F.col(c).alias(g) for c, g in zip(names, docs.columns, strict=True)])
