import numpy as np
import pytest
from pyspark.sql import datasource as S
from test_volume_files import write

from voxloom.sources import volume_files as VF
from voxloom.sources import volume_source as VS


@pytest.fixture
def folder(tmp_path):
    rng = np.random.default_rng(2)
    cubes = {k: rng.integers(0, 100, (6 + k, 5, 4)) for k in range(4)}
    for k, v in cubes.items():
        write(tmp_path / f"scan_{k}.nii{'' if k % 2 else '.gz'}", v, 4, k >= 2, 2.0, -7.0)
    return str(tmp_path), {(k, z): v[z].ravel() * 2.0 - 7 for k, v in cubes.items() for z in range(len(v))}


@pytest.mark.parametrize("part_bytes", [100, 1 << 20])
def test_all_slices_once(spark, folder, part_bytes):
    path, want = folder
    VS.register(spark)
    df = spark.read.format("volumes").option("part_bytes", part_bytes).load(path)
    rows = df.collect()
    assert len(rows) == len(want) and all(np.allclose(r.data, want[r.case_id, r.z]) for r in rows)
    plain = VF.read_volumes(spark, path)
    assert {(r.case_id, r.z, r.nx, r.ny, r.nz, r.dz, tuple(r.data)) for r in plain.collect()} == \
        {(r.case_id, r.z, r.nx, r.ny, r.nz, r.dz, tuple(r.data)) for r in rows}


@pytest.mark.parametrize("where", ["case_id = 1", "case_id in (0, 3) and z > 2", "z >= 1 and z < 3", "z = 4 and nx = 4", "z <= 2 and case_id > 1",
                                   "z = 1 and z = 2", "case_id = 9", "z in (0, 2)", "z < -1"])
def test_filters_change_no_result(spark, folder, where):
    path, _ = folder
    VS.register(spark)
    got = {(r.case_id, r.z) for r in spark.read.format("volumes").option("part_bytes", 100).load(path).where(where).collect()}
    assert got == {(r.case_id, r.z) for r in VF.read_volumes(spark, path).where(where).collect()}


def test_a_filter_on_z_reads_only_its_bytes(tmp_path, monkeypatch):
    write(tmp_path / "scan_5.nii", np.ones((400, 50, 40)), 4, False)
    read = []

    class Counted:
        def __init__(self, file):
            self.file = file

        def read(self, n):
            read.append(n)
            return self.file.read(n)

        def __getattr__(self, name):
            return getattr(self.file, name)

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.file.close()

    opened = VF._open
    monkeypatch.setattr(VF, "_open", lambda path: Counted(opened(path)))
    monkeypatch.setattr(VF, "_stream", lambda file, chunk=VF.HEADER_BYTES: iter(lambda: file.read(chunk), b""))
    reader = VS.VolumeReader({"path": str(tmp_path), "part_bytes": "400000"})
    assert list(reader.pushFilters([S.GreaterThanOrEqual(("z",), 120), S.LessThan(("z",), 123), S.EqualTo(("nx",), 40)])) == [S.EqualTo(("nx",), 40)]
    shares = reader.partitions()
    assert len(shares) == 5
    rows = [b for s in shares for b in reader.read(s)]
    assert [b.column("z")[0].as_py() for b in rows] == [120, 121, 122]
    assert sum(read) < 3 * 4000 + 6 * 3 * VF.HEADER_BYTES


def test_folders_below_are_read(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    write(tmp_path / "a" / "b" / "scan_7.nii", np.ones((2, 2, 2)), 4, False)
    (tmp_path / "a" / "notes_8.txt").write_text("no volume")
    VS.register(spark)
    assert [(r.case_id, r.z) for r in spark.read.format("volumes").load(str(tmp_path)).collect()] == [(7, 0), (7, 1)]


def test_errors(spark, tmp_path):
    VS.register(spark)
    assert spark.read.format("volumes").load(str(tmp_path)).count() == 0
    write(tmp_path / "scan_1.nii", np.ones((2, 2, 2)), 4, False, cut=3)
    with pytest.raises(Exception, match="early"):
        spark.read.format("volumes").load(str(tmp_path)).count()
    write(tmp_path / "other_1.nii", np.ones((2, 2, 2)), 4, False)
    with pytest.raises(Exception, match="case 1 is in"):
        spark.read.format("volumes").load(str(tmp_path)).count()
    write(tmp_path / "scan7.nii", np.ones((1, 2, 2)), 4, False)
    with pytest.raises(Exception, match="no case number"):
        spark.read.format("volumes").load(str(tmp_path)).count()
