import gzip
import os

import brute
import numpy as np
import pytest

from voxloom.sources import volume_files as VF


def write(path, v, code, gz, slope=1.0, inter=0.0, cut=0):
    raw = VF.make_header(v.shape[2], v.shape[1], v.shape[0], code, (0.5, 0.6, 1.5), slope, inter, mask=False) \
        + v.astype(VF.IMAGE_TYPES.get(code, "<f8")).tobytes()
    raw = raw[:len(raw) - cut] if cut else raw
    with open(path, "wb") as f:
        f.write(gzip.compress(raw) if gz else raw)


@pytest.mark.parametrize("gz", [True, False])
def test_six_types_round_trip(spark, tmp_path, gz):
    rng = np.random.default_rng(0)
    want = {}
    for i, code in enumerate(VF.IMAGE_TYPES):
        v = rng.integers(0, 100, (3, 4, 5))
        want[i] = v * 2.0 - 7
        # The name says nothing about compression: content decides.
        write(tmp_path / f"scan_{i}.nii{'' if i % 2 else '.gz'}", v, code, gz, 2.0, -7.0)
    rows = VF.read_volumes(spark, str(tmp_path), part_bytes=40).collect()
    assert len(rows) == 18 and {(r.nx, r.ny, r.nz) for r in rows} == {(5, 4, 3)}
    for r in rows:
        assert np.allclose(r.data, want[r.case_id][r.z].ravel()) and abs(r.dz - 1.5) < 1e-6


def test_zero_slope_means_one(spark, tmp_path):
    write(tmp_path / "a_1.nii", np.ones((1, 2, 2)), 4, False, 0.0, 3.0)
    assert VF.read_volumes(spark, str(tmp_path)).first().data == [4.0] * 4


def test_bad_files(spark, tmp_path):
    write(tmp_path / "a_1.nii", np.ones((2, 2, 2)), 4, False, cut=3)
    write(tmp_path / "a_2.nii", np.ones((2, 2, 2)), 64, False)
    (tmp_path / "a_3.nii").write_bytes(b"short")
    (tmp_path / "a_4.nii").write_bytes(gzip.compress(b"x" * 9000)[:30])
    with pytest.raises(Exception, match="early|unsupported|truncated|bad dims"):
        VF.read_volumes(spark, str(tmp_path)).count()
    write(tmp_path / "a_5.nii", np.ones((2, 2, 2)), 2, True)
    write(tmp_path / "a_6.nii.gz", np.ones((3, 2, 2)), 4, True, cut=3)
    rows = VF.read_volumes(spark, str(tmp_path), skip_bad=True, part_bytes=8).collect()
    assert [r.case_id for r in rows] == [5, 5]     # all slices of a file or none
    bad = {os.path.basename(r.path): r.reason for r in VF.rejected_volumes(spark, str(tmp_path)).collect()}
    assert set(bad) == {"a_1.nii", "a_2.nii", "a_3.nii", "a_4.nii", "a_6.nii.gz"} and "3 bytes early" in bad["a_1.nii"]


def test_case_numbers_are_needed_and_unique(spark, tmp_path):
    write(tmp_path / "scan7.nii", np.ones((1, 2, 2)), 4, False)
    with pytest.raises(Exception, match="no case number in"):
        VF.read_volumes(spark, str(tmp_path)).count()
    for folder in "ab":
        (tmp_path / "two" / folder).mkdir(parents=True)
        write(tmp_path / "two" / folder / "s_1.nii", np.ones((1, 2, 2)), 4, False)
    with pytest.raises(Exception, match="case 1 is in"):
        VF.read_volumes(spark, str(tmp_path / "two" / "*"))


def test_every_mask_is_written_once(spark, tmp_path):
    n = 200
    heads = spark.range(0, n, 1, 16).selectExpr("cast(id AS int) AS case_id", "cast(null AS binary) AS header", "3 AS nx", "2 AS ny", "2 AS nz")
    runs = spark.range(0, n, 1, 16).selectExpr("cast(id AS int) AS case_id", "1 AS z", "0 AS y", "0 AS x0", "cast(id % 3 AS int) AS x1",
                                               "3 AS nx", "2 AS ny", "2 AS nz")
    out = str(tmp_path / "masks")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        done = VF.write_masks(runs, heads, out)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    names = {f for f in os.listdir(out) if f.startswith("mask_")}
    assert names == {f"mask_{i}.nii.gz" for i in range(n)}
    times = {f: os.stat(f"{out}/{f}").st_mtime_ns for f in names}
    assert {r.case_id: r.voxels for r in done.collect()} == {i: i % 3 + 1 for i in range(n)} and done.count() == n
    assert {f: os.stat(f"{out}/{f}").st_mtime_ns for f in names} == times


def test_labels_accept_plain_and_gzip_but_not_every_type(spark, tmp_path):
    v = np.array([[[0, 3], [1, 0]]])
    write(tmp_path / "l_1.nii.gz", v, 4, True, 5.0, 5.0)
    write(tmp_path / "l_2.nii", v, 2, False, 5.0, 5.0)
    got = {r.case_id: r.data for r in VF.read_volumes(spark, str(tmp_path), label=True).collect()}
    assert got == {1: [0, 1, 1, 0], 2: [0, 3, 1, 0]}
    write(tmp_path / "l_3.nii", v, 8, False)
    with pytest.raises(Exception, match="unsupported"):
        VF.read_volumes(spark, str(tmp_path), label=True).count()


def test_mask_files(spark, tmp_path):
    rng = np.random.default_rng(2)
    ms = {1: rng.random((4, 5, 6)) < 0.4, 2: np.zeros((2, 3, 3), bool), 3: rng.random((3, 3, 2)) < 0.5}
    src = tmp_path / "in"
    src.mkdir()
    for k, m in ms.items():
        write(src / f"s_{k}.nii.gz", m, 4, True)
    heads = VF.read_headers(spark, str(src))
    out = str(tmp_path / "out")
    done = {r.case_id: r.voxels for r in VF.write_masks(brute.runs_frame(spark, ms), heads, out).collect()}
    assert done == {k: int(m.sum()) for k, m in ms.items()}
    assert sorted(os.listdir(out)) == ["_manifest", "mask_1.nii.gz", "mask_2.nii.gz", "mask_3.nii.gz"]
    back = VF.read_volumes(spark, out, label=True).collect()
    for r in back:
        assert (np.array(r.data).reshape(r.ny, r.nx) == ms[r.case_id][r.z]).all()
    with gzip.open(f"{out}/mask_1.nii.gz") as f:
        raw = f.read()
    assert len(raw) == 352 + ms[1].size and raw[344:348] == VF.MAGIC and VF.parse_header(raw)["type"] == 2


def test_runs_without_a_header_are_an_error(spark, tmp_path):
    ms = {1: np.ones((1, 1, 2), bool), 2: np.ones((1, 1, 7), bool)}
    for k in (1, 2):
        out = str(tmp_path / f"out{k}")
        heads = spark.createDataFrame([(k, None, ms[k].shape[2], 1, 1)], "case_id int, header binary, nx int, ny int, nz int")
        with pytest.raises(Exception, match="has runs but no header row"):
            VF.write_masks(brute.runs_frame(spark, ms).coalesce(1), heads, out)
        assert not [f for f in os.listdir(out) if f.endswith(".part")] if os.path.isdir(out) else True
        assert not os.path.exists(f"{out}/mask_{3 - k}.nii.gz")
    twice = spark.createDataFrame([(1, None, 2, 1, 1)] * 2, "case_id int, header binary, nx int, ny int, nz int")
    with pytest.raises(Exception, match="more than one header row"):
        VF.write_masks(brute.runs_frame(spark, {1: ms[1]}), twice, str(tmp_path / "twice"))
    small = spark.createDataFrame([(2, None, 3, 1, 1)], "case_id int, header binary, nx int, ny int, nz int")
    with pytest.raises(Exception, match="outside its grid"):
        VF.write_masks(brute.runs_frame(spark, {2: ms[2]}), small, str(tmp_path / "grid"))


def test_training_slices(spark):
    v = np.linspace(-1200, 800, 2 * 4 * 6).reshape(2, 4, 6)
    m = (v > 0).astype(float)
    out = VF.prepare_slices(brute.slices_frame(spark, {0: v}), brute.slices_frame(spark, {0: m}), 4).collect()
    assert len(out) == 2 and {len(r.image) for r in out} == {16} and {r.z: r.has_airway for r in out} == {0: 0, 1: 1}
    flat = VF.prepare_slices(brute.slices_frame(spark, {0: np.full((1, 4, 4), -200.0)}),
                             brute.slices_frame(spark, {0: np.ones((1, 4, 4))}), 4).first()
    assert set(flat.image) == {128} and set(flat.mask) == {1}
