"""What the corpus operators share: shared-folder tables, size-checked joins, text kernels.

``stash`` writes a table to the folder that ``spark.checkpoint.dir`` names and reads it
back.  Lineage ends there, so a lost executor costs no recomputation, and nothing is
computed twice.  The files go when the driver's JVM ends.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.session import ensure_checkpoint_dir

#: ASCII white space, the only separator of words here; Java and Python read it alike.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A small table is broadcast up to so many rows, counted first; beyond, adaptive execution joins it.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def stash(df: DataFrame, name: str = "stash") -> DataFrame:
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings of the session for what is run inside; then as they were."""
    before = {key: spark.conf.get(key, None) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def bring(df: DataFrame, small: DataFrame, on: list[str], how: str = "inner", rows: int | None = None) -> DataFrame:
    """Join a stashed summary to a large frame: broadcast within ``BROADCAST_ROWS``, else a plain equi-join."""
    rows = small.count() if rows is None else rows
    return df.join(F.broadcast(small) if rows <= BROADCAST_ROWS else small, on, how)


def whole(text: Column | str) -> Column:
    """Null texts are empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def n_words(text: Column) -> Column:
    """Words between ASCII white space; null: 0."""
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def uniform(*parts: Column) -> Column:
    """A number inside (0, 1) that depends on the values alone, so reruns agree."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + 0.5) * F.lit(2.0 ** -53)


# --- kernels inside Arrow tasks ---

#: Bytes of text that a kernel works on at once; its scratch arrays take about 60 times as much.
CHUNK_BYTES = 2_000_000


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column, nulls as empty texts, without copying the texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer text is a range of its own."""
    start, n = 0, len(offsets) - 1
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        stop = min(n, max(stop, start + 1))
        yield start, stop
        start = stop


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finisher: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


#: Longer stretches are hashed one by one by a cryptographic hash.
LONG_BYTES = 64
_KEEP = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on as one number, zeros past the end."""
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[:len(raw)] = raw
    return np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))


def stretch_hashes(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte stretches; equal bytes give equal hashes wherever they lie.

    Eight bytes at a time go through the finisher, which starts from the length; no sum of
    bytes is formed, so texts that differ only in the order of their parts stay apart.
    """
    sizes = (stops - starts).astype(np.int64)
    out = mixed(sizes.astype(np.uint64) * _ODD + np.uint64(1))
    eights = _eights(raw)
    live = np.flatnonzero((sizes > 0) & (sizes <= LONG_BYTES))
    at, left, h = starts[live], sizes[live], out[live]
    while len(live):
        h = mixed((h ^ (eights[at] & _KEEP[np.minimum(left, 8)])) * _ODD)
        more = left > 8
        done = live[~more]
        out[done] = h[~more]
        live, at, left, h = live[more], at[more] + 8, left[more] - 8, h[more]
    long = np.flatnonzero(sizes > LONG_BYTES)
    if len(long):
        data = memoryview(raw.tobytes())
        out[long] = [int.from_bytes(hashlib.blake2b(data[a:b], digest_size=8).digest(), "little")
                     for a, b in zip(starts[long].tolist(), stops[long].tolist(), strict=True)]
    return out


def same_stretches(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray, others: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether the bytes of each stretch are those of the other one beside it."""
    sizes = stops - starts
    out = sizes == ends - others
    eights = _eights(raw)
    live = np.flatnonzero(out & (sizes > 0) & (starts != others))
    a, b, left = starts[live], others[live], sizes[live]
    while len(live):
        keep = _KEEP[np.minimum(left, 8)]
        equal = (eights[a] & keep) == (eights[b] & keep)
        out[live[~equal]] = False
        more = equal & (left > 8)
        live, a, b, left = live[more], a[more] + 8, b[more] + 8, left[more] - 8
        if len(live) < 16:      # a few long ones
            data = memoryview(raw.tobytes())
            for i in live.tolist():
                out[i] = data[starts[i]:stops[i]] == data[others[i]:ends[i]]
            break
    return out


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def folded(raw: np.ndarray) -> np.ndarray:
    """ASCII letters in lower case."""
    return _FOLD[raw]


def word_bounds(raw: np.ndarray, offsets: np.ndarray, outside: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and stops of the words of all texts, and the number of words of each text; ``outside`` tells bytes between words."""
    inside = ~outside[raw]
    first = np.zeros(len(raw), bool)
    first[offsets[:-1][offsets[:-1] < len(raw)]] = True
    before = np.concatenate(([False], inside[:-1])) if len(raw) else inside
    starts = np.flatnonzero(inside & (~before | first))
    last = np.zeros(len(raw), bool)
    ends = offsets[1:][offsets[1:] > 0] - 1
    last[ends] = True
    after = np.concatenate((inside[1:], [False])) if len(raw) else inside
    stops = np.flatnonzero(inside & (~after | last)) + 1
    per_text = np.searchsorted(starts, offsets[1:]) - np.searchsorted(starts, offsets[:-1])
    return starts, stops, per_text


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes start, start+1, … for each (start, length), one after another."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)
