"""Volumes as a data source: ``spark.read.format("volumes").load(folder)``.

``register(spark)`` makes the format known.  Options: ``label`` (read masks), ``part_bytes``
(stored bytes a task reads, 64 MB) and ``suffixes`` (comma-separated, ``.nii,.nii.gz``).

Planning lists the folder and nothing else: a file of n bytes becomes ``n / part_bytes``
equal shares of its slices, and the tasks, not the driver, open files and read headers.  A
plain file is read by all its shares; a gzip file cannot be split, so its first share reads
it through and the others are empty.

With ``spark.sql.python.filterPushdown.enabled`` filters on ``case_id`` leave files out of
the plan (the number is in the name), and comparisons of ``z`` with numbers narrow the range of slices, so
only their bytes are read from plain files.  Spark still applies what it cannot push.

Cases: a name without a case number, two files with one number and bad files are errors; a
folder without volumes gives no rows.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql import datasource as S
from pyspark.sql import types as T

from voxloom.sources import volume_files as VF
from voxloom.sources.tables import DIMS

SOURCE_SCHEMA = T.StructType([T.StructField("case_id", T.IntegerType()), *VF.VOLUME_SCHEMA.fields])
PART_BYTES = 64 << 20


@dataclass
class Share(S.InputPartition):
    """One of ``of`` equal shares of a file's slices."""
    path: str
    case: int
    share: int
    of: int


def case_number(path: str) -> int:
    """The digits behind the last underscore of a file name."""
    found = re.match(r"[0-9]+", posixpath.basename(path).rsplit("_", 1)[-1])
    if not found:
        raise VF.VolumeError(f"no case number in {path}")
    return int(found.group())


def listed(folder: str, suffixes: tuple[str, ...]) -> list[tuple[str, int]]:
    """(path, bytes) of the volumes of a folder and the folders below, or of the one file that is named."""
    uri = folder if "://" in folder else "file://" + folder.removeprefix("file:")
    fs, root = pafs.FileSystem.from_uri(uri)
    info = fs.get_file_info(root)
    found = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(root, recursive=True))
    front = uri[:len(uri) - len(root)] if uri.endswith(root) else uri.split("://")[0] + "://"
    return sorted((front + f.path, f.size) for f in found if f.is_file and f.path.endswith(suffixes))


class VolumeReader(S.DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.label = str(options.get("label", "false")).lower() == "true"
        self.part_bytes = int(options.get("part_bytes", PART_BYTES))
        self.suffixes = tuple(options.get("suffixes", ".nii,.nii.gz").split(","))
        self.cases: set[int] | None = None
        self.low, self.high = 0, 1 << 31      # wanted slices: low <= z < high

    def pushFilters(self, filters: list[S.Filter]) -> Iterable[S.Filter]:
        for f in filters:
            if not self._takes(f):
                yield f

    def _takes(self, f: S.Filter) -> bool:
        name, value = getattr(f, "attribute", None), getattr(f, "value", None)
        if isinstance(f, S.IsNotNull):
            return name in (("case_id",), ("z",))
        if name == ("case_id",) and isinstance(f, (S.EqualTo, S.In)):
            asked = {value} if isinstance(f, S.EqualTo) else set(value)
            self.cases = asked if self.cases is None else self.cases & asked
            return True
        if name != ("z",) or not isinstance(value, int):
            return False
        low, high = {S.EqualTo: (value, value + 1), S.GreaterThan: (value + 1, self.high), S.GreaterThanOrEqual: (value, self.high),
                     S.LessThan: (0, value), S.LessThanOrEqual: (0, value + 1)}.get(type(f), (None, None))
        if low is None:
            return False
        self.low, self.high = max(self.low, low), min(self.high, high)
        return True

    def partitions(self) -> list[Share]:
        out, owner = [], {}
        for path, size in listed(self.folder, self.suffixes):
            case = case_number(path)
            if case in owner:
                raise VF.VolumeError(f"case {case} is in {owner[case]} and in {path}")
            owner[case] = path
            if self.cases is None or case in self.cases:
                of = max(1, -(-size // self.part_bytes))
                out += [Share(path, case, i, of) for i in range(of)]
        # An empty list would be read as one partition without a share.
        return out or [Share("", 0, 0, 0)]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        if not partition.of or self.low >= self.high:
            return
        try:
            head, packed = VF.check_file(partition.path, self.label, False)
            first, last = (head["nz"] * (partition.share + i) // partition.of for i in (0, 1))
            if packed:
                first, last = (0, head["nz"]) if partition.share == 0 else (0, 0)
            first, last = max(first, self.low), min(last, self.high)
            if first >= last:
                return
            for head, z, data in VF.read_part(partition.path, first, last, self.label):
                row = {"case_id": partition.case, "z": z} | {d: head[d] for d in DIMS}
                yield pa.RecordBatch.from_pydict({
                    **{c: pa.array([v], pa.int32()) for c, v in row.items()}, "path": [partition.path],
                    **{c: pa.array([head[c]], pa.float32()) for c in ("dx", "dy", "dz")},
                    "data": pa.array([data], pa.list_(pa.float32()))}).select(SOURCE_SCHEMA.names)
        except (VF.VolumeError, VF.zlib.error) as error:
            raise VF.VolumeError(f"{partition.path}: {error}") from error


class VolumeSource(S.DataSource):
    @classmethod
    def name(cls) -> str:
        return "volumes"

    def schema(self) -> T.StructType:
        return SOURCE_SCHEMA

    def reader(self, schema: T.StructType) -> VolumeReader:
        return VolumeReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the format ``volumes`` known to a session, with filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(VolumeSource)
