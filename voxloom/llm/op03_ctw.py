"""Language-model scores by context-tree weighting over bytes.

Texts become a stream of bytes: words in lower case (A-Z) with one space between, then an
end byte.  Each byte is eight binary decisions; each decision, in each context of the last
0 to D bytes, has a Krichevsky-Trofimov estimate from its counts in the training
documents.  Context-tree weighting mixes them over all depths: with Pe the estimate of
what a context has seen and Pw = 1/2 Pe + 1/2 prod Pw(children), a context keeps weight
Pe / (2 Pw) for its own estimate and leaves the rest to the context one byte longer.

What is counted are runs of D+1 bytes ("grams"), from which all shorter contexts and all
eight decisions follow.  Nothing of the model is broadcast but its two topmost levels,
whose size is bounded by 256 * 255 decisions:

1. each stretch of documents (a block: some thousand rows of one file) gives its distinct
   grams and words with their training counts;
2. counts are summed by gram; grams that share their last two context bytes meet, and
   give the weights of all deeper contexts, which are summed up for the top;
3. with the top known, they give the log probability of each gram;
4. each block's grams meet the probabilities, go back to the block, and the documents of
   the block are scored one after another.

So memory follows a block and a pair of context bytes, never the corpus, while the model
grows with it; texts reach Python some MB at a time.  Words travel as 64-bit hashes for the base score, their counts in full;
prices are rounded to single precision.

Cases: null texts are empty: the end alone; the ids of held-out documents have a CRC-32
divisible by 10, a null id is text ``null``; without training documents counts are 0 and
every decision is even; rows that repeat stay and count each; no rows give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _KEEP, _ODD, _eights, buffers, settings, slices, stash, stretch_hashes, whole
from .op06_exact import AT, located

DEPTH = 5
#: Rows of a file that make a block.
BLOCK_DOCS = 8192
#: Bytes of text that are taken apart at once; what they hold is merged before it is kept.
CHUNK_BYTES = 500_000
#: Bytes of rows that Spark hands to Python at once; whole texts are otherwise taken by the 10,000.
BATCH_BYTES = 4 << 20
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_END = 10   # the end byte; never inside a word
_END_WORD = 0   # the hash that stands for the end token
_HALF = math.log(0.5)


def stream(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts, each behind ``depth`` end bytes and before one; start and stop of what is scored."""
    pad = b"\n" * depth
    bodies = [b" ".join(t.translate(_LOWER).split()) for t in texts]
    sizes = np.array([len(b) for b in bodies], np.int64) + depth + 1
    stop = np.cumsum(sizes)
    return np.frombuffer(b"".join([pad + b + b"\n" for b in bodies]), np.uint8), stop - sizes + depth, stop


def grams(raw: np.ndarray, start: np.ndarray, stop: np.ndarray, depth: int) -> np.ndarray:
    """Per scored byte: the byte before it, the one before that, …, then the byte itself, as one number."""
    edge = np.zeros(len(raw) + 1, np.int32)
    np.add.at(edge, start, 1)
    np.add.at(edge, stop, -1)
    scored = np.cumsum(edge[:-1]) > 0
    # Read as one number, the bytes before a byte have the nearest on top.
    before = _eights(raw)[:max(len(raw) - depth, 0)] & _KEEP[depth]
    return ((before << np.uint64(8)) | raw[depth:]).view(np.int64)[scored[depth:]]


def words_of(raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, the end of each as its last, and the tokens of each text."""
    inside = np.zeros(len(raw) + 1, bool)
    inside[:-1] = (raw != 32) & (raw != _END)
    begins = np.flatnonzero(inside[:-1] & ~np.concatenate(([False], inside[:-2])))
    ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    hashes = stretch_hashes(raw, begins, ends).view(np.int64)
    hashes[hashes == _END_WORD] = 1
    n = np.searchsorted(begins, stop) - np.searchsorted(begins, start)
    out = np.full(len(hashes) + len(n), _END_WORD, np.int64)
    place = np.cumsum(n + 1) - 1
    mask = np.ones(len(out), bool)
    mask[place] = False
    out[mask] = hashes
    return out, n + 1


def _texts(column: pa.Array) -> list[bytes]:
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def _first(keys: np.ndarray) -> np.ndarray:
    """Where each distinct key of a sorted array begins."""
    return np.flatnonzero(np.concatenate((keys[:1] == keys[:1], keys[1:] != keys[:-1])))


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of all parts, sorted, and the sums of their counts; quick if the keys of each part are sorted."""
    keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = _first(keys)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def joined(one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """As ``merged`` for two parts, each of sorted distinct keys, with little room besides the result; takes over the counts of ``one``."""
    (keys, counts), (more, n) = one, other
    place = np.searchsorted(keys, more)
    known = np.zeros(len(more), bool)
    inside = place < len(keys)
    known[inside] = keys[place[inside]] == more[inside]
    counts[place[known]] += n[known]
    place = place[~known]
    return np.insert(keys, place, more[~known]), np.insert(counts, place, n[~known])


def added(parts: list[tuple[np.ndarray, np.ndarray]], part: tuple[np.ndarray, np.ndarray] | None = None) -> None:
    """Add a part, sizes at least halving from one to the next, so all are under twice the largest; without a part, leave a single one."""
    if part is not None:
        parts.append(part)
    while len(parts) > 1 and (part is None or 2 * len(parts[-1][0]) > len(parts[-2][0])):
        last = parts.pop()
        parts.append(joined(parts.pop(), last))


def tallied(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and how often each occurs in training; plain sorts, without the places of the keys."""
    parts = []
    for counted in (True, False):
        own = np.sort(keys[train == counted])
        first = _first(own)
        parts.append((own[first], np.diff(first, append=len(own)) * int(counted)))
    return merged(parts)


class Lookup:
    """Values of the distinct keys of a block, found by hashing: a step or two into a table at most half full."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values
        self.bits = max(2 * len(keys), 2).bit_length()
        self.owner = np.full(1 << self.bits, -1, np.int32)
        left, slot = np.arange(len(keys), dtype=np.int32), self._slots(keys)
        while len(left):
            free = self.owner[slot] < 0
            self.owner[slot[free]] = left[free]
            more = self.owner[slot] != left
            left, slot = left[more], (slot[more] + 1) & (len(self.owner) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        bits = keys.view(np.uint64)
        return (((bits ^ (bits >> np.uint64(32))) * _ODD) >> np.uint64(64 - self.bits)).view(np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slots(keys)
        found = self.owner[slot]
        other = np.flatnonzero(self.keys[found] != keys)
        while len(other):
            if (found[other] < 0).any():
                raise KeyError("a text has grams or words that its block was not counted with")
            slot[other] = (slot[other] + 1) & (len(self.owner) - 1)
            found[other] = self.owner[slot[other]]
            other = other[self.keys[found[other]] != keys[other]]
        return self.values[found]


def _tally(depth: int):
    """Distinct grams (kind 0) and words (kind 1) of each block with their counts in training documents.

    The rows of a block follow one another, so a task holds the counts of one block only.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]
        current = None

        def put() -> Iterator[pa.RecordBatch]:
            for kind, parts in enumerate(held):
                added(parts)
                for keys, counts in parts:
                    for a in range(0, len(keys), 100_000):
                        k = keys[a:a + 100_000]
                        yield pa.RecordBatch.from_pydict({
                            "block": np.full(len(k), current), "kind": np.full(len(k), kind, np.int32), "key": k,
                            "n": counts[a:a + 100_000]})
                parts.clear()
        for batch in batches:
            _, offsets = buffers(batch.column("text"))
            blocks = batch.column("block").to_numpy()
            edges = (np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist()
            for begin, end in zip([0, *edges], [*edges, batch.num_rows], strict=True):
                if begin == end:
                    continue
                if blocks[begin] != current:
                    yield from put()
                    current = blocks[begin]
                for a, b in slices(offsets[begin:end + 1], CHUNK_BYTES):
                    part = batch.slice(begin + a, b - a)
                    train = ~part.column("held_out").to_numpy(zero_copy_only=False)
                    raw, start, stop = stream(_texts(part.column("text")), depth)
                    words, per_text = words_of(raw, start, stop)
                    added(held[0], tallied(grams(raw, start, stop, depth), np.repeat(train, stop - start)))
                    added(held[1], tallied(words, np.repeat(train, per_text)))
        yield from put()
    return run


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series from x + 8 on, carried back by the recurrence."""
    y = x + 8.0
    series = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y ** 3) + 1 / (1260 * y ** 5)
    for i in range(8):
        series = series - np.log(x + i)
    return series


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log probability that Krichevsky and Trofimov's estimate gives to so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - math.log(math.pi) - log_gamma(zeros + ones + 1.0)


def _reduce(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys of a sorted array, the place of each entry among them, and sums."""
    new = np.concatenate(([True], keys[1:] != keys[:-1]))
    first = np.flatnonzero(new)
    return keys[first], np.cumsum(new) - 1, [np.add.reduceat(v, first) for v in values]


def deep(keys: np.ndarray, counts: np.ndarray, depth: int, floor: int) -> tuple[list[tuple], np.ndarray]:
    """Grams sorted by context: per decision level the contexts of depth ``floor``, and the mixed chances from there on.

    Of each level: (context, decision node, zeros, ones, log Pw) of the contexts of depth
    ``floor``.  The chances are those of each gram's eight bits, mixed over the depths
    from ``floor`` to ``depth``.
    """
    n = counts.astype(float)
    context, byte = keys >> 8, keys & 255
    levels, chances = [], np.empty((8, len(keys)))
    for bit in range(8):
        node = (1 << bit) | (byte >> (8 - bit))
        one = (byte >> (7 - bit)) & 1
        below = mixed = None
        for d in range(depth, floor - 1, -1):
            own = ((context >> (8 * (depth - d))) << 8) | node
            order = np.argsort(own, kind="stable")
            kept, place_sorted, (zeros, ones) = _reduce(own[order], (n * (1 - one))[order], (n * one)[order])
            place = np.empty(len(own), np.int64)
            place[order] = place_sorted
            log_e = log_kt(zeros, ones)
            mine = np.where(one == 1, ones[place], zeros[place])
            kt = (mine + 0.5) / (zeros + ones + 1.0)[place]
            if below is None:
                log_w, mixed = log_e, kt
            else:
                child_keys, child_log = below
                parent = np.searchsorted(kept, ((child_keys >> 16) << 8) | (child_keys & 255))
                log_w = np.logaddexp(log_e + _HALF, np.bincount(parent, child_log, minlength=len(kept)) + _HALF)
                share = np.exp(log_e + _HALF - log_w)[place]
                mixed = share * kt + (1 - share) * mixed
            below = (kept, log_w)
        levels.append((kept >> 8, kept & 255, zeros, ones, log_w))
        chances[bit] = mixed
    return levels, chances


def _groups(batches: Iterator[pa.RecordBatch], shift: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Grams and counts, some contexts at a time, from batches sorted by gram; a context is never cut."""
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        keys = np.concatenate((keys, batch.column("key").to_numpy()))
        counts = np.concatenate((counts, batch.column("n").to_numpy()))
        if len(keys) > 50_000:
            cut = int(np.searchsorted(keys >> shift, keys[-1] >> shift))
            if cut:
                yield keys[:cut], counts[:cut]
                keys, counts = keys[cut:], counts[cut:]
    if len(keys):
        yield keys, counts


def _summits(depth: int):
    """Sums over the contexts of two bytes, per last byte and decision."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, counts in _groups(batches, 8 * (depth - 1)):
            for context, node, zeros, ones, log_w in deep(keys, counts, depth, 2)[0]:
                yield pa.RecordBatch.from_pydict({"last": context >> 8, "node": node, "zeros": zeros, "ones": ones, "log_w": log_w})
    return run


class Top:
    """The two topmost levels: estimates without context and with the last byte, and their weights."""

    def __init__(self, rows):
        zeros, ones, below = (np.zeros((257, 256)) for _ in range(3))
        last, node = rows["last"].to_numpy(np.int64), rows["node"].to_numpy(np.int64)
        for table, name in ((zeros, "zeros"), (ones, "ones"), (below, "log_w")):
            table[last, node] = rows[name]
        zeros[256], ones[256] = zeros.sum(0), ones.sum(0)
        log_e = log_kt(zeros, ones)
        log_w = np.logaddexp(log_e + _HALF, below + _HALF)
        log_w[256] = np.logaddexp(log_e[256] + _HALF, log_w[:256].sum(0) + _HALF)
        self.share = np.exp(log_e + _HALF - log_w)
        self.one = (ones + 0.5) / (zeros + ones + 1.0)

    def mix(self, keys: np.ndarray, chances: np.ndarray, depth: int) -> np.ndarray:
        """Log10 probability of each gram's byte."""
        last, byte = keys >> (8 * depth), keys & 255
        total = np.zeros(len(keys))
        for bit in range(8):
            node, one = (1 << bit) | (byte >> (8 - bit)), (byte >> (7 - bit)) & 1
            chance = chances[bit]
            for row in (last, np.full(len(keys), 256)):
                kt = np.where(one == 1, self.one[row, node], 1 - self.one[row, node])
                chance = self.share[row, node] * kt + (1 - self.share[row, node]) * chance
            total += np.log10(chance)
        return total


def _priced(depth: int, top: Top):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, counts in _groups(batches, 8 * (depth - 1)):
            yield pa.RecordBatch.from_pydict({"key": keys, "kind": np.zeros(len(keys), np.int32),
                                              "value": top.mix(keys, deep(keys, counts, depth, 2)[1], depth).astype(np.float32).astype(float)})
    return run


def _scorer(depth: int, train: int, distinct: int):
    """Rows of a partition sorted by block, values before texts (key: doc_id, value: held out): doc_id, held_out, counts and scores."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts, tables = None, ([], []), None

        def settle() -> list[Lookup]:
            out = []
            for kind in (0, 1):
                keys = np.concatenate([k for k, _ in parts[kind]]) if parts[kind] else np.zeros(0, np.int64)
                values = np.concatenate([v for _, v in parts[kind]]) if parts[kind] else np.zeros(0)
                out.append(Lookup(keys, values))
                parts[kind].clear()
            return out
        for batch in batches:
            blocks, kinds = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
            edges = np.flatnonzero((blocks[1:] != blocks[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
                if a == b:
                    continue
                part, kind = batch.slice(a, b - a), int(kinds[a])
                if blocks[a] != block:
                    block, tables = blocks[a], None
                    parts[0].clear()
                    parts[1].clear()
                if kind < 2:
                    # Copies, which do not keep the other columns alive.
                    parts[kind].append((part.column("key").to_numpy().copy(), part.column("value").to_numpy().copy()))
                    continue
                tables = tables or settle()
                _, offsets = buffers(part.column("text"))
                for c, d in slices(offsets, CHUNK_BYTES):
                    raw, start, stop = stream(_texts(part.column("text").slice(c, d - c)), depth)
                    prices = tables[0].of(grams(raw, start, stop, depth))
                    sizes = stop - start
                    begin = np.cumsum(sizes) - sizes
                    words, per_text = words_of(raw, start, stop)
                    seen = tables[1].of(words)
                    base = np.log10((seen + 0.1) / (train + 0.1 * (distinct + 1)))
                    first = np.cumsum(per_text) - per_text
                    score = np.add.reduceat(prices, begin)
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": part.column("key").slice(c, d - c), "held_out": part.column("value").slice(c, d - c).cast(pa.bool_()),
                        "n_tokens": per_text.astype(np.int64), "n_known": np.add.reduceat((seen > 0).astype(np.int64), first),
                        "train_tokens": np.full(len(sizes), train), "base_score": np.add.reduceat(base, first),
                        "score": score, "bits_per_byte": -score / sizes / math.log10(2)})
    return run


def score(docs: DataFrame, depth: int = DEPTH, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    with settings(docs.sparkSession, {"spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)}):
        return stash(_scored(docs, depth, block_docs), "scores")


def _scored(docs: DataFrame, depth: int, block_docs: int) -> DataFrame:
    label = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = located(docs.select("doc_id", "text")).select(
        "doc_id", whole("text").alias("text"), (F.crc32(F.encode(label, "UTF-8")) % 10 == 0).alias("held_out"),
        F.xxhash64("_file", F.floor(F.col("_row") / block_docs)).alias("block"))
    tally = stash(rows.mapInArrow(_tally(depth), "block long, kind int, key long, n long"), "tally")
    sums = stash(tally.groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    words = sums.where("kind = 1 and n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    model = (sums.where("kind = 0").withColumn("_at", F.shiftright("key", 8 * (depth - 1)))
             .repartition("_at").sortWithinPartitions("key").select("key", "n"))
    tops = model.mapInArrow(_summits(depth), "last long, node long, zeros double, ones double, log_w double").groupBy(
        "last", "node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("log_w").alias("log_w")).toPandas()
    prices = model.mapInArrow(_priced(depth, Top(tops)), "key long, kind int, value double")
    counts = sums.where("kind = 1").select("key", "kind", F.col("n").cast("double").alias("value"))
    known = tally.select("block", "kind", "key").join(prices.unionByName(counts), ["kind", "key"])
    columns = ["block", "kind", "key", "value"]
    both = known.select(*columns, F.lit(None).cast("string").alias("text")).unionByName(rows.select(
        "block", F.lit(2).alias("kind"), F.col("doc_id").cast("long").alias("key"), F.col("held_out").cast("double").alias("value"), "text"))
    return both.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(
        _scorer(depth, words[0], words[1]), "doc_id long, held_out boolean, n_tokens long, n_known long, "
        "train_tokens long, base_score double, score double, bits_per_byte double")
