"""Whole compositions against direct NumPy versions, presets, and the safety rules."""

import brute
import numpy as np
import pytest

from voxloom.operators import grow as G
from voxloom.operators import measure as M
from voxloom.operators import rescue as Q
from voxloom.operators import runs as N
from voxloom.operators.connect import component_stats, components
from voxloom.plans.presets import PRESETS, resolve
from voxloom.plans.rules import SafetyParams, decide
from voxloom.plans.segment import score, segment


def volumes():
    rng = np.random.default_rng(11)
    out = {}
    for k, shape in enumerate([(13, 12, 12), (9, 16, 13)]):
        v = rng.normal(-455, 45, shape)
        z, y, x = np.indices(shape)
        v -= 160 * np.exp(-((x - shape[2] // 2) ** 2 + (y - shape[1] // 2) ** 2) / 6.0)
        out[k] = np.round(v)
    return out


P = G.PyramidParams(coarse_low=-900.0, coarse_high=-500.0, adaptive=False, cap_share=0.08, step=15.0, dilate=3)


def brute_trunk(coarse, p):
    nz, ny, nx = coarse.shape
    cap, sizes, masks = int(p.cap_share * coarse.size), [], []
    for t in range(p.tries):
        cand = (coarse >= p.coarse_low) & (coarse <= p.coarse_high - p.step * t)
        inner = np.zeros(cand.shape, bool)
        for z in range(nz):
            plane = cand[z:z + 1]
            inner[z] = (plane & ~brute.flood(plane, brute.lateral(plane), axes=2))[0]
        masks.append(brute.flood(inner, brute.axis_seeds(inner)))
        sizes.append(int(masks[-1].sum()))
        if sizes[-1] <= cap:
            return masks[-1]
    filled = [(s, t) for t, s in enumerate(sizes) if s]
    return masks[min(filled)[1]] if filled else masks[-1]


def brute_constraint(v, p):
    nz, ny, nx = (n // 2 for n in v.shape)
    coarse = v[:2 * nz, :2 * ny, :2 * nx].reshape(nz, 2, ny, 2, nx, 2).mean((1, 3, 5))
    trunk = brute_trunk(coarse, p)
    areas = sorted(int(s.sum()) for s in trunk if s.any())
    if areas:
        med = areas[len(areas) // 2]
        for z in range(nz):
            if trunk[z].any():
                ys, xs = np.nonzero(trunk[z])
                w, h = np.ptp(xs) + 1, np.ptp(ys) + 1
                if len(xs) > 8 * med + 50 and (w > nx // 2 or h > ny // 2 or len(xs) / (w * h) < 0.5):
                    trunk[z] = False
    trunk = brute.box(trunk, (p.dilate + 1) // 2)
    at = [np.minimum(np.arange(n) // 2, m - 1) for n, m in zip(v.shape, trunk.shape)]
    return trunk[np.ix_(*at)]


def robust(mask):
    need = max(8, mask.shape[0] // 4)
    for frac in (0.10, 0.15, 0.25, 0.5):
        seeds = brute.axis_seeds(mask, frac)
        if len(seeds) >= need:
            return seeds
    return seeds or [(z, *np.argwhere(mask[z])[0]) for z in range(mask.shape[0]) if mask[z].any()]


def test_pyramid(spark):
    vs = volumes()
    s = brute.slices_frame(spark, vs)
    cand = {k: v <= -500 for k, v in vs.items()}
    got = brute.as_masks(N.to_voxels(G.pyramid_mask(s, brute.runs_frame(spark, cand), None, P)), vs)
    for k, v in vs.items():
        core = cand[k] & brute_constraint(v, P)
        assert core.any()
        assert (got[k] == brute.flood(core, robust(core))).all()


def settings(**more):
    return dict(band_lo=-900.0, band_hi=-500.0, body_thr=-440.0, roi_margin=0, **more)


def test_plain_preset_is_band_interior_and_seeds(spark):
    vs = volumes()
    cfg = resolve("none", **settings(use_roi=False))
    got = brute.as_masks(N.to_voxels(segment(brute.slices_frame(spark, vs), cfg)), vs)
    from test_stencils import smooth
    from voxloom.functions.voxel import gaussian_taps
    for k, v in vs.items():
        band = (lambda g: (g >= -900) & (g <= -500))(smooth(v, gaussian_taps(2, 1.0)))
        inner = band & ~brute.flood(band, brute.lateral(band))
        assert (got[k] == brute.flood(inner, brute.axis_seeds(inner))).all()


def test_model_presets_agree_with_their_operators(spark):
    vs = volumes()
    s = brute.slices_frame(spark, vs).withColumn("prob", __import__("pyspark").sql.functions.expr(
        "transform(data, v -> cast((-v - 300) / 400 as float))"))
    for preset in ("gate", "hybrid", "v14", "v15"):
        cfg = resolve(preset, hybrid_hu_lo=-520.0, hybrid_hu_hi=-420.0, use_roi=False, abort_ratio=50.0)
        got = brute.as_masks(N.to_voxels(segment(s, cfg)), vs)
        for k, v in vs.items():
            p = ((-v - 300) / 400).astype(np.float32)
            core = p > np.float32(0.5)
            if preset == "gate":
                lo = int((p > np.float32(0.4)).sum())
                mask = core if (lo - core.sum()) / max(core.sum(), 1) > 0.5 else p > np.float32(0.4)
                want = brute.flood(mask, robust(mask))
            elif preset == "hybrid":
                mask = core | ((p > np.float32(0.1)) & (v >= -520) & (v <= -420))
                want = brute.flood(mask, robust(core))
            else:
                mask = p > np.float32(0.5 if preset == "v14" else 0.4)
                want = brute.flood(mask, robust(mask))
            assert (got[k] == want).all(), preset


def test_classical_is_its_stages_in_order(spark):
    from test_stencils import cube, smooth
    from voxloom.functions.voxel import gaussian_taps
    from voxloom.operators.stencils import vesselness
    vs = volumes()
    s = brute.slices_frame(spark, vs)
    cfg = resolve("classical", **settings(
        coarse_low=-900.0, coarse_high=-500.0, adaptive=False, dilate=3, vmin=0.01, thr_periph=-440.0, rescue_min=0,
        cap_share=0.08, feedback_step=15.0, wavefront=(("thr_trunk", -520.0), ("hu_abs_max", -430.0), ("leak_base", 20)),
        use_roi=False))
    assert not cfg.adaptive and cfg.vessel and cfg.loose
    got = brute.as_masks(N.to_voxels(segment(s, cfg)), vs)
    tubes = vesselness(s, incremental=True)
    for k, v in vs.items():
        cons = brute_constraint(v, cfg.pyramid_params())
        soft = smooth(v, gaussian_taps(2, 1.0))
        core = (soft >= -900) & (soft <= -500) & cons
        score_ = cube(tubes.where(f"case_id = {k}"), "vness", v.shape)
        want, _ = brute.wavefront(v, score_, core, cons, robust(core), cfg.wavefront_params())
        assert want.sum() > core.sum() > 0
        assert (got[k] == want).all()


def test_rescue_replaces_an_empty_mask(spark):
    v = np.full((24, 20, 20), -300.0)
    v[2:20, 9:12, 9:12] = -700.0
    v[:, 0, :] = v[:, -1, :] = v[:, :, 0] = v[:, :, -1] = -1000.0
    cfg = resolve("v6", band_lo=-2000.0, band_hi=-1500.0, body_thr=-400.0, roi_margin=0, coarse_high=-1500.0,
                  adaptive=False, rescue_min=10, tube=(("min_size", 20),))
    got = brute.as_masks(N.to_voxels(segment(brute.slices_frame(spark, {0: v}), cfg)), {0: v})[0]
    assert got.sum() == 18 * 9 and got[5, 10, 10] and not got[5, 0, 0]


def test_tube_shape_filter(spark):
    tube, ball = np.zeros((14, 30, 30), bool), np.zeros((14, 30, 30), bool)
    tube[1:13, 10:13, 10:13] = True
    ball[1:13, 8:20, 8:20] = True
    stats = component_stats(components(brute.runs_frame(spark, {0: tube, 1: ball}))).selectExpr(
        "*", "0 wx0", "29 wx1", "0 wy0", "29 wy1", "0 wz0", "13 wz1")
    assert [r.case_id for r in Q.tube_score(stats, Q.RescueParams(min_size=100)).collect()] == [0]
    assert Q.tube_score(stats, Q.RescueParams(min_size=200)).count() == 0


def test_gate_rows(spark):
    rows = [(k, 0.45 if i >= hi else 0.6) for k, (lo, hi) in enumerate([(150, 100), (151, 100), (5, 0)]) for i in range(lo)]
    got = {r.case_id: (r.n_lo, r.n_hi, r.thr) for r in M.gate(spark.createDataFrame(rows, "case_id int, prob float")).collect()}
    assert got == {0: (150, 100, 0.4), 1: (151, 100, 0.5), 2: (5, 0, 0.4)}


def test_score_of_equal_empty_disjoint_masks(spark):
    a = np.zeros((2, 3, 4), bool)
    b = a.copy()
    a[0, 0, :2], b[1, 1, 1] = True, True
    one, two = brute.runs_frame(spark, {0: a, 1: a}), brute.runs_frame(spark, {0: a, 1: b})
    got = {r.case_id: (r.pred, r.gt, r.inter, r.dice) for r in score(one, two).collect()}
    assert got == {0: (2, 2, 2, 1.0), 1: (2, 1, 0, 0.0)}
    assert {r.case_id: r.dice for r in score(two, one).collect()} == {0: 1.0, 1: 0.0}
    nothing = brute.runs_frame(spark, {0: np.zeros((2, 3, 4), bool)})
    dims = spark.createDataFrame([(0, 4, 3, 2), (5, 4, 3, 2)], "case_id int, nx int, ny int, nz int")
    assert {r.case_id: r.dice for r in score(nothing, nothing, dims).collect()} == {0: 1.0, 5: 1.0}
    assert {r.case_id: r.dice for r in score(one, nothing, dims, dims.where("case_id < 5")).collect()} == {0: 0.0}
    empty = spark.createDataFrame([(0, 0, 0, 0)], "case_id int, p int, g int, z int")
    assert M.dice_of_flags(empty, empty.p > 0, empty.g > 0).first().dice == 1.0


def test_safety_rules_in_order(spark):
    rows = [(0, 250_001, 100_000, 0, 0), (1, 250_000, 100_000, 0, 0), (2, 640_000, 400_000, 0, 0), (3, 500_000, 79_999, 0, 0),
            (4, 14_999, 0, 15_500, 0), (5, 14_999, 0, 600_001, 0), (6, 14_999, 0, 14_999, 0), (7, 300_001, 0, 0, 30_000),
            (8, 14_000, 0, 100_000, 24_000), (9, 300_001, 0, 0, 19_999)]
    got = {r.case_id: r.source for r in decide(spark.createDataFrame(
        rows, "case_id int, wavefront long, pyramid long, rescue long, anchored long"), SafetyParams()).collect()}
    assert got == {0: "pyramid", 1: "wavefront", 2: "pyramid", 3: "wavefront", 4: "rescue", 5: "wavefront", 6: "wavefront",
                   7: "anchored", 8: "anchored", 9: "wavefront"}


def test_a_table_configuration_needs_its_table(spark):
    from voxloom.plans.segment import segment
    with pytest.raises(ValueError, match="table"):
        segment(brute.slices_frame(spark, {0: np.zeros((3, 4, 5))}), resolve("classical", lut=True))


def test_presets():
    for name in PRESETS:
        resolve(name)
    c = resolve("classical")
    w = c.wavefront_params()
    assert (w.thr_trunk, w.thr_periph, w.max_level, w.vmin, w.leak_factor, w.leak_base, w.leak_ratio, w.hu_abs_max) == \
        (-950.0, -820.0, 60, 0.03, 3.0, 800, 3.0, -500.0)
    old = resolve("v5").wavefront_params()
    assert (old.vmin, old.leak_factor, old.leak_base, old.leak_ratio, old.hu_abs_max) == (0.06, 2.0, 400, 1.5, -750.0)
    assert c.rescue_min == 15_000 and resolve("v6").rescue_min == 10_000
    assert resolve("gate", "fast").stride == 128 and resolve("gate").stride == 96 and resolve("v15").model_thr == 0.4
    mixed = resolve("model-2p5d", "gate")
    assert mixed.slice_model and mixed.gate and mixed.batch == 16
    assert resolve("v13").swap_ratio == 5.0 and resolve("v12").rescue_aware_swap
    with pytest.raises(ValueError):
        resolve("unheard-of")
    with pytest.raises(ValueError):
        resolve("gate", no_such_setting=1)


def test_model_maps_come_back_on_the_stored_grid(spark):
    from pyspark.sql import functions as F
    from voxloom.plans.segment import with_model
    v = np.add.outer(np.add.outer(-40.0 * np.arange(9), -10.0 * np.arange(10)), 5.0 * np.arange(11)) - 300
    s = brute.slices_frame(spark, {0: v}).select("*", F.lit(0.8).alias("dx"), F.lit(0.7).alias("dy"), F.lit(2.0).alias("dz"))

    def ramp(tensor):
        p = np.clip(tensor[:, 0].astype(np.float64), 1e-6, 1 - 1e-6)
        return np.stack([np.zeros_like(p), np.log(p / (1 - p))], axis=1)

    unit = np.clip((np.clip(v, -1000, 600) + 1000) / 1600, 1e-6, 1)
    for cfg in (resolve("gate", patch=8, stride=6), resolve("gate", patch=16, stride=12, spacing=(0.6, 0.6, 1.0))):
        rows = with_model(s, cfg, ramp).collect()
        assert sorted(r.z for r in rows) == list(range(9))
        for r in rows:
            assert np.allclose(r.prob, unit[r.z].ravel(), atol=1e-5)


def test_plans_are_usable_from_sql(spark):
    from voxloom.sources.tables import register_views
    v = volumes()
    register_views(vox=brute.voxel_frame(spark, v))
    got = {r.case_id: r.n for r in spark.sql("SELECT case_id, count(*) n FROM vox WHERE hu <= -500 GROUP BY case_id").collect()}
    assert got == {k: int((a <= -500).sum()) for k, a in v.items()}
