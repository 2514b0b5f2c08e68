"""Volume files (348-byte header, then voxels; plain or gzip) as slice rows, and back.

Files are listed by Spark; tasks then read them directly.  A plain file is split into
ranges of slices, so one huge volume is still read by many tasks.  A gzip file cannot be
split, but it is decoded as a stream and never held whole.
"""

from __future__ import annotations

import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.sources.logs import case_of
from voxloom.sources.tables import DIMS

# Header layout (offsets), voxel type codes, magic words.
HEADER_BYTES = 348
DATA_OFFSET = 352
AT_DIM, AT_TYPE, AT_BITS, AT_SPACING, AT_OFFSET = 40, 70, 72, 76, 108
AT_SLOPE, AT_INTER, AT_MAX, AT_MIN, AT_MAGIC = 112, 116, 124, 128, 344
IMAGE_TYPES = {2: "<u1", 4: "<i2", 8: "<i4", 16: "<f4", 256: "<i1", 512: "<u2"}
LABEL_TYPES = {2: "<u1", 4: "<i2", 256: "<i1"}
MAGIC = b"n+1\0"
GZIP_MAGIC = b"\x1f\x8b"

VOLUME_SCHEMA = T.StructType(
    [T.StructField("path", T.StringType()), T.StructField("z", T.IntegerType())]
    + [T.StructField(c, T.IntegerType()) for c in DIMS]
    + [T.StructField(c, T.FloatType()) for c in ("dx", "dy", "dz")]
    + [T.StructField("data", T.ArrayType(T.FloatType()))])
HEADER_SCHEMA = T.StructType(
    [T.StructField("path", T.StringType()), T.StructField("header", T.BinaryType())]
    + [T.StructField(c, T.IntegerType()) for c in DIMS])


class VolumeError(ValueError):
    """A file that is not a readable volume."""


def _open(path: str):
    """Input file on any file system pyarrow reaches (local, HDFS, object stores)."""
    uri = path if "://" in path else "file://" + path.removeprefix("file:")
    fs, name = pafs.FileSystem.from_uri(uri)
    return fs.open_input_file(name)


def _stream(file, chunk: int = 1 << 20) -> Iterator[bytes]:
    """Bytes in pieces; gzip is recognised by its first bytes, not by the name."""
    pieces = iter(lambda: file.read(chunk), b"")
    first = next(pieces, b"")
    if first[:2] != GZIP_MAGIC:
        yield first
        yield from pieces
        return
    member, pending = zlib.decompressobj(31), first
    while pending:
        out = member.decompress(pending, chunk)
        if out:
            yield out
        pending = member.unconsumed_tail
        if member.eof:
            pending = member.unused_data or next(pieces, b"")
            if pending[:2] != GZIP_MAGIC:
                return
            member = zlib.decompressobj(31)
        elif not pending:
            pending = next(pieces, b"")
            if not pending:
                raise VolumeError("truncated gzip data")


class _Reader:
    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.buffer = pieces, bytearray()

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n:
            piece = next(self.pieces, None)
            if piece is None:
                raise VolumeError(f"file ends {n - len(self.buffer)} bytes early")
            self.buffer += piece
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out


def parse_header(h: bytes) -> dict:
    dim = struct.unpack_from("<8h", h, AT_DIM)
    spacing = struct.unpack_from("<8f", h, AT_SPACING)
    nx, ny, nz = dim[1], dim[2], dim[3] if dim[0] >= 3 else 1
    if nx <= 0 or ny <= 0 or nz <= 0:
        raise VolumeError(f"bad dims {nx}x{ny}x{nz}")
    offset, slope, inter = (struct.unpack_from("<f", h, a)[0] for a in (AT_OFFSET, AT_SLOPE, AT_INTER))
    return {"nx": nx, "ny": ny, "nz": nz, "dx": spacing[1], "dy": spacing[2], "dz": spacing[3],
            "type": struct.unpack_from("<h", h, AT_TYPE)[0], "offset": int(offset),
            "slope": slope if slope != 0 else 1.0, "inter": inter}


def voxel_type(head: dict, label: bool) -> np.dtype:
    code = (LABEL_TYPES if label else IMAGE_TYPES).get(head["type"])
    if code is None:
        raise VolumeError(f"unsupported voxel type {head['type']}")
    return np.dtype(code)


def decode_plane(raw: bytes, dtype: np.dtype, head: dict, label: bool) -> np.ndarray:
    stored = np.frombuffer(raw, dtype)
    if not label:
        return stored.astype(np.float32) * np.float32(head["slope"]) + np.float32(head["inter"])
    return ((stored != 0) if head["type"] == 4 else stored.view(np.uint8)).astype(np.float32)


def read_part(path: str, z0: int, z1: int, label: bool) -> Iterator[tuple[dict, int, np.ndarray]]:
    """(header, z, float32 slice) for z0 <= z < z1.

    A plain file is read from the first wanted byte on; gzip can only be read through.
    """
    with _open(path) as file:
        packed = file.read(2) == GZIP_MAGIC
        file.seek(0)
        reader = _Reader(_stream(file) if packed else _stream(file, HEADER_BYTES))
        head = parse_header(reader.take(HEADER_BYTES))
        dtype = voxel_type(head, label)
        plane = head["nx"] * head["ny"] * dtype.itemsize
        skip = max(0, head["offset"] - HEADER_BYTES)
        if packed:
            reader.take(skip)
            for _ in range(z0):
                reader.take(plane)
        else:
            file.seek(HEADER_BYTES + skip + z0 * plane)
            reader = _Reader(_stream_plain(file, plane * max(0, min(z1, head["nz"]) - z0)))
        for z in range(z0, min(z1, head["nz"])):
            yield head, z, decode_plane(reader.take(plane), dtype, head, label)


def _stream_plain(file, size: int, chunk: int = 1 << 20) -> Iterator[bytes]:
    """No more than ``size`` bytes from here on."""
    while size > 0 and (piece := file.read(min(size, chunk))):
        size -= len(piece)
        yield piece


def _files(spark: SparkSession, path: str, pattern: str | None) -> DataFrame:
    """File names by Spark's own listing; contents are not fetched here.

    Two files with one case number would merge further on, so they are refused.
    """
    reader = spark.read.format("binaryFile")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    files = reader.load(path).select("path")
    twice = (files.groupBy(case_of(_stem()).alias("case_id")).agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("one"),
                                                                  F.max("path").alias("other")).where("n > 1").first())
    if twice:
        raise VolumeError(f"case {twice['case_id']} is in {twice['one']} and in {twice['other']}")
    return files


def check_file(name: str, label: bool, through: bool) -> tuple[dict, bool]:
    """Header, and whether the file is gzip.  Plain files must be long enough; ``through`` decodes gzip ones to their end."""
    with _open(name) as file:
        packed = file.read(2) == GZIP_MAGIC
        file.seek(0)
        reader = _Reader(_stream(file))
        head = parse_header(reader.take(HEADER_BYTES))
        plane = head["nx"] * head["ny"] * voxel_type(head, label).itemsize
        skip = max(0, head["offset"] - HEADER_BYTES)
        if not packed:
            short = HEADER_BYTES + skip + plane * head["nz"] - file.size()
            if short > 0:
                raise VolumeError(f"file ends {short} bytes early")
        elif through:
            reader.take(skip)
            for _ in range(head["nz"]):
                reader.take(plane)
    return head, packed


def rejected_volumes(spark: SparkSession, path: str, label: bool = False, pattern: str | None = None) -> DataFrame:
    """(path, reason) of the files that ``read_volumes`` leaves out with ``skip_bad``."""
    def reasons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("path").to_pylist():
                try:
                    check_file(name, label, True)
                except (VolumeError, zlib.error) as error:
                    yield pa.RecordBatch.from_pydict({"path": [name], "reason": [str(error)]})
    return _files(spark, path, pattern).repartition("path").mapInArrow(reasons, "path string, reason string")


def read_volumes(spark: SparkSession, path: str, label: bool = False, pattern: str | None = None,
                 skip_bad: bool = False, part_bytes: int = 64 << 20) -> DataFrame:
    """Slice rows ``case_id, path, z, nx, ny, nz, dx, dy, dz, data``.

    A first pass reads headers and plans parts: plain files are split into ranges of
    slices of about ``part_bytes``, gzip files (which cannot be split) are one part.
    Parts are then spread over tasks and decoded as streams.  ``label`` reads masks
    (stored values, no rescale).  Bad files raise; with ``skip_bad`` they give no rows at
    all (gzip files are then decoded twice) and ``rejected_volumes`` lists them.
    """
    part_schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("z0", T.IntegerType()),
                                T.StructField("z1", T.IntegerType())])

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("path").to_pylist():
                try:
                    head, packed = check_file(name, label, skip_bad)
                except (VolumeError, zlib.error) as error:
                    if skip_bad:
                        continue
                    raise VolumeError(f"{name}: {error}") from error
                size = head["nx"] * head["ny"] * voxel_type(head, label).itemsize
                step = head["nz"] if packed else max(1, part_bytes // size)
                starts = np.arange(0, head["nz"], step, dtype=np.int32)
                yield pa.RecordBatch.from_pydict({
                    "path": [name] * len(starts), "z0": pa.array(starts), "z1": pa.array(starts + np.int32(step))})

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, z0, z1 in zip(*(batch.column(c).to_pylist() for c in ("path", "z0", "z1"))):
                try:
                    for head, z, data in read_part(name, z0, z1, label):
                        row = {"path": [name], "z": pa.array([z], pa.int32())}
                        row |= {d: pa.array([head[d]], pa.int32()) for d in DIMS}
                        row |= {s: pa.array([head[s]], pa.float32()) for s in ("dx", "dy", "dz")}
                        yield pa.RecordBatch.from_pydict({**row, "data": pa.array([data], pa.list_(pa.float32()))})
                except (VolumeError, zlib.error) as error:
                    raise VolumeError(f"{name}: {error}") from error

    parts = _files(spark, path, pattern).mapInArrow(plan, part_schema).repartition("path", "z0")
    return parts.mapInArrow(decode, VOLUME_SCHEMA).select(case_of(_stem()).alias("case_id"), "*")


def _stem() -> Column:
    return F.regexp_replace("path", r"\.nii(\.gz)?$", "")


def read_headers(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """One row per file: ``case_id, path, header, nx, ny, nz``."""
    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("path").to_pylist():
                with _open(name) as file:
                    raw = _Reader(_stream(file)).take(HEADER_BYTES)
                head = parse_header(raw)
                yield pa.RecordBatch.from_pydict({
                    "path": [name], "header": pa.array([raw], pa.binary()),
                    **{d: pa.array([head[d]], pa.int32()) for d in DIMS}})

    return _files(spark, path, pattern).mapInArrow(heads, HEADER_SCHEMA) \
        .select(case_of(_stem()).alias("case_id"), "*")


def make_header(nx: int, ny: int, nz: int, code: int = 2, spacing=(1.0, 1.0, 1.0), slope: float = 1.0,
                inter: float = 0.0, base: bytes | None = None, mask: bool = True) -> bytes:
    """A 352-byte header; ``base`` keeps the other fields of an existing one."""
    h = bytearray((base or b"")[:HEADER_BYTES].ljust(DATA_OFFSET, b"\0"))
    if base is None:
        struct.pack_into("<i", h, 0, HEADER_BYTES)
        struct.pack_into("<8h", h, AT_DIM, 3, nx, ny, nz, 1, 1, 1, 1)
        struct.pack_into("<8f", h, AT_SPACING, 1.0, *spacing, 1.0, 1.0, 1.0, 1.0)
    struct.pack_into("<h", h, AT_TYPE, code)
    struct.pack_into("<h", h, AT_BITS, 8 * np.dtype(IMAGE_TYPES.get(code, "<u1")).itemsize)
    for at, value in ((AT_OFFSET, float(DATA_OFFSET)), (AT_SLOPE, slope), (AT_INTER, inter)):
        struct.pack_into("<f", h, at, value)
    if mask:
        struct.pack_into("<f", h, AT_MAX, 1.0)
        struct.pack_into("<f", h, AT_MIN, 0.0)
    h[AT_MAGIC:AT_MAGIC + 4] = MAGIC
    return bytes(h)


def write_masks(runs: DataFrame, headers: DataFrame, out: str) -> DataFrame:
    """Write one gzip mask file per case, now; returns the stored manifest ``case_id, file, voxels``.

    The manifest is written by the same job, to ``_manifest`` beside the masks, so each
    mask is written once whatever is done with the result.

    Rows reach the writer sorted by case, slice and line, and each file is written as
    a stream of slices, so memory is one slice however large the case.  A file gets
    its final name only when complete, so a retried task never leaves half a file.
    ``headers`` has one row per case (``case_id, header, nx, ny, nz``; null header =
    make one); cases without runs get an empty mask.  Runs of a case without a header
    row, a second header row for a case, and runs outside the header's grid are errors: no file
    of that case is left, and no other case's file takes its runs.
    """
    none = F.lit(None)
    head = headers.select("case_id", F.lit(-1).alias("z"), F.lit(0).alias("y"), F.lit(0).alias("x0"),
                          F.lit(0).alias("x1"), *DIMS, F.col("header").cast("binary").alias("header"))
    body = runs.select("case_id", "z", "y", "x0", "x1", *DIMS, none.cast("binary").alias("header"))
    ordered = head.unionByName(body).repartition("case_id").sortWithinPartitions("case_id", "z", "y", "x0")
    schema = T.StructType([ordered.schema["case_id"], T.StructField("file", T.StringType()),
                           T.StructField("voxels", T.LongType())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = None
        try:
            for batch in batches:
                case = batch.column("case_id").to_numpy(zero_copy_only=False)
                cuts = np.flatnonzero(np.concatenate(([True], case[1:] != case[:-1]))).tolist() if len(case) else []
                for a, b in zip(cuts, [*cuts[1:], len(case)]):
                    part = batch.slice(a, b - a)
                    heads = int((part.column("z").to_numpy() == -1).sum())
                    if heads:
                        if heads > 1 or (current and current.case == case[a]):
                            raise ValueError(f"case {case[a]} has more than one header row")
                        if current:
                            done, current = current.finish(), None
                            yield done
                        nx, ny, nz, header = (part.column(c)[0].as_py() for c in (*DIMS, "header"))
                        current = _MaskFile(out, int(case[a]), nx, ny, nz, header)
                        part = part.slice(1)
                    elif current is None or current.case != case[a]:
                        raise ValueError(f"case {case[a]} has runs but no header row")
                    current.add_all(*(part.column(c).to_numpy() for c in ("z", "y", "x0", "x1")))
            if current:
                done, current = current.finish(), None
                yield done
        finally:
            if current:
                current.drop()

    manifest = f"{out.rstrip('/')}/_manifest"
    ordered.mapInArrow(write, schema).write.mode("overwrite").parquet(manifest)
    return ordered.sparkSession.read.schema(schema).parquet(manifest)


class _MaskFile:
    def __init__(self, out: str, case: int, nx: int, ny: int, nz: int, header: bytes | None):
        target = out if "://" in out else "file://" + out
        self.fs, root = pafs.FileSystem.from_uri(target)
        self.fs.create_dir(root, recursive=True)
        self.case, self.name = case, posixpath.join(root, f"mask_{case}.nii.gz")
        self.part = f"{self.name}.{uuid.uuid4().hex}.part"
        self.nz, self.plane, self.z, self.voxels = nz, np.zeros((ny, nx), np.uint8), 0, 0
        self.zip, self.file = zlib.compressobj(1, zlib.DEFLATED, 31), self.fs.open_output_stream(self.part)
        self.put(make_header(nx, ny, nz, base=header))

    def put(self, data: bytes) -> None:
        self.file.write(self.zip.compress(data))

    def next_slice(self) -> None:
        self.put(self.plane.tobytes())
        self.plane[:] = 0
        self.z += 1

    def add_all(self, z: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> None:
        """Runs in the order of their slices; a slice's runs are painted together."""
        ny, nx = self.plane.shape
        if len(z) and (min(z.min(), y.min(), x0.min()) < 0 or z.max() >= self.nz or y.max() >= ny or x1.max() >= nx or (x1 < x0).any()):
            raise ValueError(f"case {self.case} has runs outside its grid")
        cuts = np.flatnonzero(np.concatenate(([True], z[1:] != z[:-1]))) if len(z) else z
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(z)]):
            while self.z < z[a]:
                self.next_slice()
            length = x1[a:b].astype(np.int64) - x0[a:b] + 1
            ends = np.cumsum(length)
            at = np.arange(ends[-1]) + np.repeat(y[a:b].astype(np.int64) * nx + x0[a:b] - (ends - length), length)
            self.plane.reshape(-1)[at] = 1
            self.voxels += int(ends[-1])

    def drop(self) -> None:
        """Leave no half-written part behind."""
        self.file.close()
        self.fs.delete_file(self.part)

    def finish(self) -> pa.RecordBatch:
        while self.z < self.nz:
            self.next_slice()
        self.file.write(self.zip.flush())
        self.file.close()
        self.fs.move(self.part, self.name)
        return pa.RecordBatch.from_pydict({"case_id": pa.array([self.case], pa.int32()), "file": [self.name],
                                           "voxels": pa.array([self.voxels], pa.int64())})


def prepare_slices(images: DataFrame, labels: DataFrame, size: int = 256, lo: float = -1000.0,
                   hi: float = 600.0) -> DataFrame:
    """Training slices: (x-major) image as bytes, resized bilinearly, and its mask, resized to nearest.

    Images without a label are dropped.  Pixel centres are aligned, values are clipped,
    scaled to 0..255 and rounded half to even.
    """
    both = images.select("case_id", "z", *DIMS, "data").join(
        labels.select("case_id", "z", F.col("data").alias("label")), ["case_id", "z"])
    schema = T.StructType([both.schema["case_id"], T.StructField("z", T.IntegerType()),
                           T.StructField("n_in_case", T.IntegerType()), T.StructField("has_airway", T.IntegerType()),
                           T.StructField("image", T.BinaryType()), T.StructField("mask", T.BinaryType())])

    def sample(plane: np.ndarray, axis: int) -> np.ndarray:
        n = plane.shape[axis]
        pos = np.maximum((np.arange(size) + 0.5) * n / size - 0.5, 0)
        i0 = np.minimum(pos.astype(int), n - 1)
        t = np.expand_dims(pos - i0, 1 - axis)
        return np.take(plane, i0, axis) * (1 - t) + np.take(plane, np.minimum(i0 + 1, n - 1), axis) * t

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            images_, masks, has = [], [], []
            for nx, ny, data, label in zip(*(batch.column(c).to_pylist() for c in ("nx", "ny")),
                                           batch.column("data"), batch.column("label")):
                hu = np.asarray(data.values.to_numpy(zero_copy_only=False), np.float64).reshape(ny, nx).T
                unit = (np.clip(hu, lo, hi) - lo) / (hi - lo) * 255.0
                images_.append(np.rint(sample(sample(unit, 0), 1)).astype(np.uint8).tobytes())
                m = np.asarray(label.values.to_numpy(zero_copy_only=False)).reshape(ny, nx).T
                near = [np.arange(size) * n // size for n in m.shape]
                masks.append(m[np.ix_(*near)].astype(np.uint8).tobytes())
                has.append(int((m != 0).any()))
            yield pa.RecordBatch.from_pydict({
                "case_id": batch.column("case_id"), "z": batch.column("z"), "n_in_case": batch.column("nz"),
                "has_airway": pa.array(has, pa.int32()), "image": pa.array(images_, pa.binary()),
                "mask": pa.array(masks, pa.binary())})

    return both.mapInArrow(prepare, schema)
