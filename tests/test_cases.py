import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.operators import case_stats as S
from voxloom.operators import lut as L
from voxloom.sources import logs
from voxloom.streaming import lut_stream


def pairs(spark, a, b):
    return spark.createDataFrame([("p", i, x, y) for i, (x, y) in enumerate(zip(a, b))], "pair string, case_id int, a double, b double")


def test_paired_tests_by_hand(spark):
    a, b = [0.9, 0.8, 0.7, 0.95, 0.6, 0.5, 0.4], [0.8, 0.8, 0.75, 0.9, 0.5, 0.3, 0.45]
    df = pairs(spark, a, b)
    d = S.cliffs_delta(df).first()
    gt, lt = sum(x > y for x in a for y in b), sum(x < y for x in a for y in b)
    assert (d.gt, d.lt) == (gt, lt) and abs(d.delta - (gt - lt) / 49) < 1e-12
    w = S.wilcoxon(df).first()
    # |d|: .1 .05 .05 .1 .2 .05 -> ranks 4.5 2 2 4.5 6 2; negatives are the 2nd and the last.
    assert (w.n, w.w_pos, w.w_neg, w.w) == (6, 17.0, 4.0, 4.0)
    assert abs(w.rank_biserial - 13 / 21) < 1e-12
    sd = math.sqrt(6 * 7 * 13 / 24 - ((27 - 3) + (8 - 2)) / 48)
    assert abs(w.z - (4 - 10.5) / sd) < 1e-12
    assert abs(w.p - math.erfc(abs(w.z) / math.sqrt(2))) < 1e-6


@pytest.mark.parametrize("z", [0.0, 0.5, 1.96, 4.0, 8.5, 9.4])
def test_two_sided_p_keeps_relative_accuracy(spark, z):
    p = spark.range(1).select(S.two_sided_p(F.lit(z)).alias("p")).first().p
    assert abs(p / math.erfc(z / math.sqrt(2)) - 1) < 1e-5


def test_effect_labels(spark):
    from voxloom.functions.voxel import effect_size
    got = [r.m for r in spark.createDataFrame([(v,) for v in (0.1, -0.147, 0.33, -0.474)], "d double").select(effect_size(F.col("d")).alias("m")).collect()]
    assert got == ["negligible", "small", "medium", "large"]


def log_text(total=None, dice=None):
    out = "[load] x.nii dims=512x512x300\n"
    if dice:
        out += f"[dice] pred=10 gt=12 inter=9  Dice=0.1\n[dice] pred=10 gt=12 inter=9  Dice={dice}\n"
    if total:
        out += f"=== Timing (s) ===\n  load        :    0.195\n  eval (dice) :    0.295\n  other/sync  :    0.010\n  TOTAL       : {total:>8}\n"
    return out


def test_log_files(spark, tmp_path):
    (tmp_path / "run_30.log").write_text(log_text("4.740", "0.6932"))
    (tmp_path / "run_100.log").write_text(log_text(None, "0.5000"))
    (tmp_path / "run_7.log").write_text(log_text())
    (tmp_path / "run_8.log").write_text(log_text(None, "0.91."))
    raw = logs.read_logs(spark, str(tmp_path)).withColumn("case_id", logs.case_of(F.col("path")))
    rows = {r.case_id: r for r in logs.parse_logs(raw, ["case_id"]).orderBy("case_id").collect()}
    assert list(rows) == [30, 100]
    r = rows[30]
    assert (r.nz, r.dice, r.pred_voxels, r.gt_voxels, r.load_s, r.eval_s, r.other_s, r.total_s, r.infer_s) == \
        (300, 0.6932, 10, 12, 0.195, 0.295, 0.010, 4.74, None)
    assert rows[100].total_s is None and rows[100].dice == 0.5
    with pytest.raises(Exception, match="no case number in"):
        spark.createDataFrame([("/a/case30.log",)], "path string").select(logs.case_of(F.col("path"))).collect()
    out = str(tmp_path / "csv")
    logs.write_results(spark.createDataFrame([(3, 4, 5, 6)], logs.CASE_DIMS), out)
    assert logs.read_results(spark, out, logs.CASE_DIMS).collect()[0].asDict() == {"case_id": 3, "nx": 4, "ny": 5, "nz": 6}


def test_monitor_and_history(spark, tmp_path):
    (tmp_path / "m.txt").write_text("#Time gpu sm mem\n 10:00:00 0 40 10\n 10:00:01 0 100 30\n 10:00:02 0 - -\n")
    r = logs.monitor_stats(spark.read.text(str(tmp_path / "m.txt"))).first()
    assert (r.sm_mean, r.sm_max, r.mem_mean) == (70.0, 100.0, 20.0)
    (tmp_path / "h.json").write_text('[{"epoch":1,"loss":0.5,"val_dice":0.7},{"epoch":2,"loss":0.4,"val_dice":0.69},{"epoch":3,"loss":0.3,"val_dice":0.71}]')
    h = logs.read_history(spark, str(tmp_path / "h.json")).withColumn("run", F.lit(1))
    got = [(r.epoch, r.best, r.improved) for r in S.best_so_far(h, "epoch", "val_dice", "run", 2).orderBy("epoch").collect()]
    assert got == [(1, 0.7, True), (2, 0.7, False), (3, 0.71, True)]


def test_split_is_seeded_and_disjoint():
    ids = [str(i) for i in range(120)]
    train, held = S.split_cases(ids, 0.10)
    assert len(held) == 12 and not set(train) & set(held) and S.split_cases(ids[::-1], 0.10)[1] == held
    assert len(S.split_cases(ids[:19], 0.2, rounding=int)[1]) == 3


def test_any_number_of_series(spark):
    df = spark.range(210).select((F.col("id") % 3).cast("int").alias("case_id"), F.format_string("s%02d", F.expr("id div 3")).alias("series"),
                                 (F.col("id") / 210).alias("dice"))
    got = S.paired(df)
    assert got.count() == 3 * 70 * 69 // 2 and got.select("pair").distinct().count() == 70 * 69 // 2
    assert S.shared_cases(df).count() == 210
    partly = df.where("series <> 's07' or case_id <> 1")
    assert {r.case_id for r in S.shared_cases(partly).collect()} == {0, 2}
    sets = {r.pair: r for r in S.failed_sets(partly, 0.2).collect()}
    assert len(sets) == 70 * 69 // 2
    assert (sets["s00 vs s01"].n_a, sets["s00 vs s01"].n_shared, sets["s00 vs s01"].equal) == (3, 3, True)
    assert (sets["s00 vs s07"].n_b, sets["s00 vs s07"].n_shared, sets["s00 vs s07"].equal) == (2, 2, False)
    assert sets["s00 vs s69"].disjoint and sets["s00 vs s69"].n_b == 0


def voxels(spark, n, shift=0):
    return spark.range(n).select(((F.col("id") * 37 + shift) % 400 - 1000).cast("double").alias("value"),
                                 ((F.col("id") * 13) % 250).cast("double").alias("grad"), (F.col("id") % 5 == 0).alias("hit"))


def test_counts_add_up_in_store_and_stream(spark, tmp_path):
    spec = L.LutSpec(16, 8)
    a, b = voxels(spark, 500), voxels(spark, 700, 11)
    whole = {tuple(r) for r in L.lut_counts(a.unionByName(b), F.col("hit"), spec).collect()}
    assert {tuple(r) for r in L.lut_merge(L.lut_counts(a, F.col("hit"), spec), L.lut_counts(b, F.col("hit"), spec)).collect()} == whole
    store = str(tmp_path / "store")
    for part in (a, b):
        L.update_store(spark, store, L.lut_counts(part, F.col("hit"), spec))
    assert {tuple(r) for r in L.read_store(spark, store).collect()} == whole
    landing = str(tmp_path / "landing")
    for part in (a, b):
        part.write.mode("append").parquet(landing)
    stream = lut_stream.voxel_stream(spark, landing, a.schema, 1)
    counts = str(tmp_path / "counts")
    lut_stream.keep_counts(stream, F.col("hit"), counts, str(tmp_path / "ckpt"), spec=spec).awaitTermination(120)
    assert {tuple(r) for r in L.read_store(spark, counts).collect()} == whole


def test_a_replayed_batch_counts_once(spark, tmp_path):
    spec, store = L.LutSpec(16, 8), str(tmp_path / "store")
    a, b = voxels(spark, 300), voxels(spark, 200, 5)
    for number, part in ((0, a), (1, b), (1, b), (0, a)):
        lut_stream.count_batch(part, number, F.col("hit"), store, "s", spec)
    lut_stream.count_batch(a, 0, F.col("hit"), store, "other", spec)
    want = {tuple(r) for r in L.lut_counts(a.unionByName(b).unionByName(a), F.col("hit"), spec).collect()}
    assert {tuple(r) for r in L.read_store(spark, store).collect()} == want


def test_stream_ingest(spark, tmp_path):
    landing, table = str(tmp_path / "in"), str(tmp_path / "table")
    df = spark.createDataFrame([(1, 0, [1.0]), (2, 0, [2.0])], "case_id int, z int, data array<double>")
    for _ in range(2):
        df.write.mode("append").parquet(landing)
        lut_stream.ingest(spark, landing, table, df.schema, str(tmp_path / "c")).awaitTermination(120)
    assert spark.read.parquet(table).groupBy("case_id").count().collect().__len__() == 2
    assert spark.read.parquet(table).count() == 4


def test_half_bin_shift_of_the_look_up(spark):
    spec = L.LutSpec(4, 2, 0.0, 4.0, 2.0)
    lut = spark.createDataFrame([(0, 1, 1.0)], "gbin int, ibin int, prob double")
    vox = spark.createDataFrame([(1.0, 0.0), (1.5, 0.0), (0.5, 0.0), (9.0, 0.0)], "value double, grad double")
    assert [r.p for r in L.lut_apply(vox, lut, spec).orderBy("value").collect()] == [0.5, 1.0, 0.5, 0.0]


def test_checkpoint_folder_is_required_on_a_cluster(spark):
    from voxloom.session import cut
    df = cut(spark.range(3))
    assert df.count() == 3 and spark.sparkContext.getCheckpointDir()


def test_attach_is_the_same_join_with_and_without_broadcast(spark):
    from voxloom.session import attach
    big = spark.range(200).select((F.col("id") % 7).alias("k"), "id")
    per = big.groupBy("k").agg(F.count("*").alias("n")).where("k < 5")
    for how in ("inner", "left"):
        small, plain = (attach(big, per, ["k"], how, max_rows=m) for m in (100, 0))
        assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, small.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


def test_exact_rank_sums_equal_enumeration(spark):
    """Every way to sign the ranks, for up to 12 pairs; larger ones add up to one."""
    rng = np.random.default_rng(12)
    for n in (1, 2, 5, 12):
        d = (np.arange(n) + 1) * np.where(rng.random(n) < 0.4, -1, 1) / 100.0
        frame = spark.createDataFrame([("p", i, float(x), 0.0) for i, x in enumerate(d)], "pair string, case_id int, a double, b double")
        got = S.wilcoxon_auto(frame).first()
        signs = (np.arange(2 ** n)[:, None] >> np.arange(n)) & 1
        sums = signs @ (np.arange(n) + 1)
        assert got.exact and got.p == pytest.approx(min(1.0, 2 * (sums <= got.w).mean()))
    even = spark.range(1).select(S.exact_tail(F.lit(50), F.lit(637)).alias("p")).first().p
    assert even == pytest.approx(1.0, abs=1e-2)
    tied = spark.createDataFrame([("p", i, x, 0.0) for i, x in enumerate([0.1, -0.1, 0.2])], "pair string, case_id int, a double, b double")
    zero = spark.createDataFrame([("p", i, x, 0.0) for i, x in enumerate([0.0, -0.1, 0.2])], "pair string, case_id int, a double, b double")
    assert not S.wilcoxon_auto(tied).first().exact and not S.wilcoxon_auto(zero).first().exact
