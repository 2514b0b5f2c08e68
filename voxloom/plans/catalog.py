"""The registered queries: every operator applied to the driver tables.

Thresholds are scaled to the range of the stand-in volume (HU about -730..-290).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.functions import voxel as V
from voxloom.operators import case_stats as S
from voxloom.operators import connect as C
from voxloom.operators import grow as G
from voxloom.operators import lut as L
from voxloom.operators import measure as M
from voxloom.operators import resample as R
from voxloom.operators import rescue as Q
from voxloom.operators import runs as N
from voxloom.operators import seeds as D
from voxloom.operators import stencils as K
from voxloom.operators import tiles as T
from voxloom.operators import wavefront as W
from voxloom.plans.presets import resolve
from voxloom.plans.rules import SafetyParams, decide
from voxloom.plans.segment import segment
from voxloom.session import cut
from voxloom.sources import logs
from voxloom.sources.tables import (DIMS, case_metrics, prob_of, table, to_voxels, truth_of, volume, voxels, with_prob)

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
XYZ = ["case_id", "x", "y", "z"]

# Parameters of the registered queries, shared with their SQL.
DYADIC = [1 / 16, 4 / 16, 6 / 16, 4 / 16, 1 / 16]
LUT = L.LutSpec(64, 32, -720.0, -300.0, 200.0)
TUBE = Q.RescueParams(tuple(float(t) for t in range(-680, -559, 20)), min_size=4, min_length=2, min_aspect=1.0)
SAFETY = SafetyParams(pyramid_floor=400, abs_cap=900, rescue_min=700, rescue_cap=1500, swap_floor=200,
                      swap_ratio=3.0, swap_rescue_ratio=2.0)
FEEDBACK = G.PyramidParams(coarse_low=-800.0, coarse_high=-490.0, adaptive=False, cap_share=0.01, step=4.0)
AIR = dict(body_thr=-520.0, k=0.5, core_frac=0.9, air_ceiling=-480.0, grad_max=20.0, limits=(-560.0, -470.0),
           fallback=-500.0, few=10)
FRONT_HARD = -560
FRONT = W.WavefrontParams(thr_trunk=-540.0, thr_periph=-505.0, max_level=6, vmin=0.2, leak_factor=1.5, leak_base=40,
                          leak_ratio=0.5, cap_base=60, hu_abs_max=-500.0)
PYRAMID = G.PyramidParams(coarse_low=-800.0, coarse_high=-490.0, adaptive=True, cap_share=0.05, step=4.0, dilate=3,
                          body_thr=AIR["body_thr"], core_frac=AIR["core_frac"], air_k=AIR["k"],
                          air=tuple((k, v) for k, v in AIR.items() if k not in ("body_thr", "core_frac", "k")))
PATCH, STRIDE = 5, 3
UNIT = (-1024.0, 0.0)  # a power-of-two range, so model inputs are exact in single precision


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def stored(spark: SparkSession, d: str) -> DataFrame:
    """The slice table, derived once for queries that pass over it several times.

    A real deployment reads such a table; here it has to be made from the vectors.
    """
    return cut(volume(spark, d))


def mask(spark: SparkSession, d: str, thr: int) -> DataFrame:
    return run_mask(volume(spark, d), thr)


def run_mask(slices: DataFrame, thr: int) -> DataFrame:
    return N.slice_runs(slices, N.cells(lambda v: v <= thr, "data"))


def truth(spark: SparkSession, d: str) -> DataFrame:
    return N.slice_runs(volume(spark, d), N.cells(truth_of, "data"))


def prob_slices(slices: DataFrame) -> DataFrame:
    return slices.withColumn("prob", N.cells(prob_of, "data"))


def prob_voxels(spark: SparkSession, d: str) -> DataFrame:
    return with_prob(voxels(spark, d))


def body(spark: SparkSession, d: str) -> DataFrame:
    return tissue_box(voxels(spark, d))


def tissue_box(vox: DataFrame) -> DataFrame:
    return M.body_bbox(vox, -400.0, 1)


def xyz(runs: DataFrame, *more: str) -> DataFrame:
    return N.to_voxels(runs, keep=more).select(*XYZ, *more)


# --- pointwise -------------------------------------------------------------------------------

@query
def q_rescale_clamp(spark, d):
    return voxels(spark, d).select(*XYZ, V.clamp(V.rescale(F.col("hu"), 2.0, 24.0), *V.HU_CLAMP).alias("v"))


@query
def q_band_filter(spark, d):
    return voxels(spark, d).where(V.in_band(F.col("hu"), -650.0, -550.0)).select(*XYZ, "hu")


@query
def q_hardset(spark, d):
    return prob_voxels(spark, d).where(V.above(F.col("prob"), 0.4)).select(*XYZ)


@query
def q_hybrid_candidate(spark, d):
    p = G.HybridParams(0.5, 0.3, -560.0, -520.0)
    return prob_voxels(spark, d).where(G.hybrid_candidate(p, F.col("prob"), F.col("hu"))).select(*XYZ, "hu")


@query
def q_normalize(spark, d):
    u = V.normalize(F.col("hu"))
    return voxels(spark, d).select(*XYZ, F.round(u, 6).alias("unit"), V.quantise8(u).alias("byte"))


@query
def q_softmax(spark, d):
    l0, l1 = F.col("hu") / 100.0, (-1000.0 - F.col("hu")) / 100.0
    return voxels(spark, d).select(*XYZ, F.round(V.softmax1(l0, l1), 6).alias("prob"),
                                   V.argmax2(l0, l1).alias("class1"))


@query
def q_roi_crop(spark, d):
    return M.crop(voxels(spark, d), (2, 5), (1, 6), (3, 20)).select(*XYZ, "hu")


@query
def q_linear_index(spark, d):
    v = voxels(spark, d)
    idx = V.linear_index(F.col("x"), F.col("y"), F.col("z"), F.col("nx"), F.col("ny"))
    return V.with_decoded(v.select("case_id", "nx", "ny", idx.alias("idx"))).select(*XYZ, "idx")


# --- masks -----------------------------------------------------------------------------------

@query
def q_mask_and(spark, d):
    slices = stored(spark, d)
    return xyz(G.intersect(run_mask(slices, -500), N.dilate(run_mask(slices, -620), 1)))


def holed(spark: SparkSession, d: str, thr: int) -> DataFrame:
    return N.slice_runs(volume(spark, d), N.cells(lambda v, x, y: (v <= thr) & (x != 3), "data"))


@query
def q_dilate(spark, d):
    return xyz(N.dilate(holed(spark, d, -600), 1))


@query
def q_close(spark, d):
    return xyz(N.close(holed(spark, d, -570), 1))


@query
def q_upsample(spark, d):
    coarse = mask(spark, d, -600).select(
        "*", (F.col("nx") * 2).alias("fx"), (F.col("ny") * 2 + 1).alias("fy"), (F.col("nz") * 2 + 1).alias("fz"))
    return xyz(N.upsample2(coarse))


@query
def q_relaxed_envelope(spark, d):
    slices = prob_slices(stored(spark, d))
    core = N.slice_runs(slices, N.cells(lambda p: V.above(p, 0.6), "prob"))
    return xyz(G.relaxed_envelope(slices, core, 1, 0.45))


@query
def q_exterior2d(spark, d):
    slices = stored(spark, d)
    return xyz(G.interior2d(run_mask(slices, -500), tissue_box(to_voxels(slices))))


@query
def q_exterior3d(spark, d):
    return xyz(G.interior3d(mask(spark, d, -530)))


@query
def q_components(spark, d):
    return xyz(C.components(mask(spark, d, -550)), "label")


@query
def q_components_bricks(spark, d):
    """The same labels from bricks of 2 slices by 3 lines, contracted to the end: many borders, no finishing step."""
    return xyz(C.components(mask(spark, d, -550).drop("bz", "by"), bz=2, by=3, finish_rows=0), "label")


@query
def q_component_stats(spark, d):
    return C.component_stats(C.components(mask(spark, d, -550)))


@query
def q_component_rank(spark, d):
    stats = C.component_stats(C.components(mask(spark, d, -560))).select("*", *[
        F.lit(0 if n == 0 else 7).alias(f"w{a}{n}") for a in "xy" for n in (0, 1)],
        F.lit(0).alias("wz0"), F.lit(1000).alias("wz1"))
    best = Q.tube_score(stats, TUBE).groupBy("case_id").agg(
        F.min(F.struct((-F.col("score")).alias("s"), "label", "size")).alias("b"))
    return best.select("case_id", F.col("b.label").alias("label"), F.col("b.size").alias("size"),
                       F.round(-F.col("b.s"), 6).alias("score"))


@query
def q_region_grow(spark, d):
    seeds = voxels(spark, d).where("z = 0 and x in (3, 4) and y in (3, 4)").select(*XYZ)
    return xyz(C.region_grow(mask(spark, d, -500), seeds))


# --- measures --------------------------------------------------------------------------------

@query
def q_dice(spark, d):
    return M.dice_of_flags(voxels(spark, d), F.col("hu") <= -550,
                           truth_of(F.col("hu"), F.col("x"), F.col("y")))


@query
def q_dice_masks(spark, d):
    return M.dice(mask(spark, d, -560), truth(spark, d))


@query
def q_batch_dice(spark, d):
    per = M.dice_of_flags(voxels(spark, d).withColumn("batch", F.floor(F.col("z") / 16)), F.col("hu") <= -550,
                          truth_of(F.col("hu"), F.col("x"), F.col("y")), ("case_id", "batch"))
    return S.batch_mean_dice(per.withColumn("batch", F.concat_ws("/", "case_id", "batch"))).select(
        F.round("val_dice", 9).alias("val_dice"))


@query
def q_body_bbox(spark, d):
    return body(spark, d)


@query
def q_gate(spark, d):
    return M.gate(prob_voxels(spark, d)).withColumn("ratio", F.round("ratio", 9))


@query
def q_gate_quiet(spark, d):
    return M.gate(prob_voxels(spark, d), 0.20, 0.25, 0.03).withColumn("ratio", F.round("ratio", 9))


@query
def q_hybrid_abort(spark, d):
    return M.hybrid_abort(prob_voxels(spark, d), 0.42, 0.38, 0.5).withColumn("ratio", F.round("ratio", 9))


@query
def q_prob_stats(spark, d):
    return M.prob_stats(prob_voxels(spark, d)).select(
        "case_id", F.round("mean_prob", 9).alias("mean_prob"), F.col("max_prob").cast("double").alias("max_prob"), "n_above")


@query
def q_slice_profile(spark, d):
    return M.slice_profile(mask(spark, d, -550))


@query
def q_prune_slices(spark, d):
    return xyz(M.prune_slices(cut(mask(spark, d, -550)), factor=1, slack=3))


@query
def q_adaptive_thr(spark, d):
    return M.adaptive_threshold(volume(spark, d), **AIR)


# --- stencils --------------------------------------------------------------------------------

def smoothed(spark, d, axes="xyz", taps=None):
    return K.smooth(volume(spark, d), {"smoothed": [taps or DYADIC]}, axes)


@query
def q_gauss_x(spark, d):
    return to_voxels(smoothed(spark, d, "x"), "v", "smoothed").select(*XYZ, "v")


@query
def q_gauss3d(spark, d):
    return to_voxels(smoothed(spark, d), "v", "smoothed").select(*XYZ, "v")


@query
def q_gauss_threshold(spark, d):
    return to_voxels(smoothed(spark, d), "v", "smoothed").where(V.in_band(F.col("v"), -520.0, -505.0)).select(*XYZ)


@query
def q_validate_gauss(spark, d):
    soft = K.gaussian(volume(spark, d), 2, 1.0)
    return to_voxels(soft, "v", "smoothed").select(*XYZ, F.round("v", 6).alias("v"))


@query
def q_gauss_check(spark, d):
    """Line passes against the direct sum over all 27 neighbours, with a verdict."""
    taps = V.gaussian_taps(1, 1.0)
    slices = stored(spark, d)
    planes = {-1: "data_m1", 0: "data", 1: "data_p1"}
    cube = [F.lit(taps[i + 1] * taps[j + 1] * taps[k + 1]) * K.at(planes[k], i, j) for i in planes for j in planes for k in planes]
    direct = K.positions(K.with_z_neighbours(slices), list(planes.values()), ["case_id"]).select(*XYZ, sum(cube[1:], cube[0]).alias("v"))
    passes = to_voxels(K.gaussian(slices, 1, 1.0), "v", "smoothed").select(*XYZ, "v")
    return S.max_error(passes, direct, XYZ).select("n", F.round("max_abs", 6).alias("max_abs"), F.round("relative", 6).alias("relative"), "ok")


@query
def q_gradient(spark, d):
    return K.gradient_magnitude(volume(spark, d)).select(*XYZ, F.round("grad", 6).alias("grad"))


def hessians(spark, d):
    near = K.with_z_neighbours(volume(spark, d))
    planes = ["data", "data_m1", "data_p1"]
    h = K.hessian("data_m1", "data", "data_p1", 1.0)
    return K.positions(near, planes, ["case_id"]).select(*XYZ, *[c.alias(n) for n, c in h.items()])


@query
def q_hessian(spark, d):
    return hessians(spark, d)


@query
def q_eigen3(spark, d):
    h = ("hxx", "hyy", "hzz", "hxy", "hxz", "hyz")
    out = V.with_eigenvalues(hessians(spark, d), h, ("e1", "e2", "e3"))
    return out.select(*XYZ, *[F.round(e, 5).alias(e) for e in ("e1", "e2", "e3")])


@query
def q_vesselness(spark, d):
    return K.vesselness(volume(spark, d)).select(*XYZ, F.round("vness", 5).alias("vness"))


@query
def q_vesselness_incremental(spark, d):
    return K.vesselness(volume(spark, d), incremental=True).select(*XYZ, F.round("vness", 5).alias("vness"))


@query
def q_slice_triplet(spark, d):
    trip = K.slice_triplet(volume(spark, d))
    return K.positions(trip, ["data", "below", "above"], ["case_id"]).select(
        *XYZ, K.at("below").alias("below"), F.col("value").alias("here"), K.at("above").alias("above"))


@query
def q_downsample(spark, d):
    return to_voxels(R.downsample2(volume(spark, d)), "v").select(*XYZ, "v")


@query
def q_trilinear(spark, d):
    size = tuple(R.resampled_size(F.col(n), F.lit(s), t) for n, s, t in
                 (("nx", 0.8, 0.5), ("ny", 0.8, 0.6), ("nz", 1.25, 1.0)))
    return R.trilinear(volume(spark, d), size).select(*XYZ, F.round("value", 6).alias("v"))


# --- look-up tables --------------------------------------------------------------------------

def graded(spark, d):
    return K.gradient_magnitude(volume(spark, d))


def counts(vox):
    return L.lut_counts(vox, truth_of(F.col("value"), F.col("x"), F.col("y")), LUT)


@query
def q_lut_hist(spark, d):
    return counts(graded(spark, d))


@query
def q_lut_merge(spark, d):
    vox = graded(spark, d)
    return L.lut_merge(counts(vox.where("case_id < 4")), counts(vox.where("case_id >= 4")))


@query
def q_lut_prob(spark, d):
    return L.lut_probability(counts(graded(spark, d)), 20).withColumn("prob", F.round("prob", 9))


@query
def q_lut_apply(spark, d):
    vox = graded(spark, d)
    lut = L.lut_probability(counts(vox), 20)
    return L.lut_apply(vox, lut, LUT).select(*XYZ, F.round("p", 6).alias("p"))


# --- seeds, growth, sweeps -------------------------------------------------------------------

@query
def q_axis_seeds(spark, d):
    slices = stored(spark, d)
    return D.axis_seeds(run_mask(slices, -550), tissue_box(to_voxels(slices)), 0.3)


@query
def q_axis_seeds_robust(spark, d):
    slices = stored(spark, d)
    return D.axis_seeds_robust(run_mask(slices, -600), tissue_box(to_voxels(slices)))


@query
def q_gate_cc(spark, d):
    slices = prob_slices(stored(spark, d))
    return xyz(G.gate_components(slices, tissue_box(to_voxels(slices))))


@query
def q_gate_cc_closed(spark, d):
    p = G.GateParams(lo=0.45, hi=0.55, relax_margin=1, relax_lo=0.4, model_thr=0.55, close_margin=1)
    slices = prob_slices(stored(spark, d))
    return xyz(G.gate_components(slices, tissue_box(to_voxels(slices)), p))


@query
def q_hybrid(spark, d):
    p = G.HybridParams(0.5, 0.4, -530.0, -490.0, 1.7)
    slices = prob_slices(stored(spark, d))
    return xyz(G.hybrid_grow(slices, tissue_box(to_voxels(slices)), p))


@query
def q_rescue(spark, d):
    slices = stored(spark, d)
    found, seeds = Q.rescue_sweep(slices, tissue_box(to_voxels(slices)), TUBE)
    return seeds.join(found.select("case_id", "thr", "voxels"), "case_id")


@query
def q_feedback(spark, d):
    coarse = cut(R.downsample2(volume(spark, d)))
    thr = coarse.where("z = 0").select("case_id", F.lit(FEEDBACK.coarse_high).alias("thr"))
    return G.feedback_trunk(coarse, thr, FEEDBACK)[1]


@query
def q_pyramid(spark, d):
    slices = stored(spark, d)
    return xyz(G.pyramid_mask(slices, run_mask(slices, -500), tissue_box(to_voxels(slices)), PYRAMID))


def _front(spark, d, task_voxels: int) -> DataFrame:
    base = to_voxels(stored(spark, d))
    vox = base.select(*XYZ, *DIMS, "hu", (F.col("hu") <= FRONT_HARD).alias("hard"), F.lit(True).alias("roi"),
                      ((-F.col("hu") - 480) / 100.0).alias("vness"))
    seeds = base.where("z % 8 = 0 and x in (3, 4) and y in (3, 4)").select(*XYZ)
    return W.wavefront_grow(vox, seeds, FRONT, task_voxels=task_voxels).select(*XYZ, "level")


@query
def q_wavefront(spark, d):
    return _front(spark, d, W.TASK_VOXELS)


@query
def q_wavefront_layers(spark, d):
    """The form for keys that fit no task: every layer is a join over the cluster."""
    return _front(spark, d, 0)


@query
def q_safety_rules(spark, d):
    m = case_metrics(spark, d)
    wide = m.groupBy("case_id").agg(
        F.sum(F.when(F.col("series") == "A", F.col("n"))).alias("wavefront"),
        F.sum(F.when(F.col("series") == "N", F.col("n"))).alias("pyramid"),
        F.sum(F.when(F.col("series") == "R", F.col("n") * 2)).alias("rescue"),
        F.sum(F.when(F.col("series") == "R", F.col("n"))).alias("anchored"))
    return decide(wide, SafetyParams(2.5, 0.4, 60, 200, True, 100, 300, 80, 1.1, 1.05))


@query
def q_classical(spark, d):
    cfg = resolve("classical", band_lo=-800.0, band_hi=-500.0, body_thr=-400.0, roi_margin=1, coarse_low=-800.0,
                  dilate=3, cap_share=0.05, feedback_step=4.0, thr_periph=-505.0, vmin=0.0001, core_frac=0.9, air_k=0.5, rescue_min=40, pyramid_floor=20,
                  air=tuple((k, v) for k, v in AIR.items() if k not in ("body_thr", "core_frac", "k")),
                  tube=(("thresholds", TUBE.thresholds), ("min_size", 4), ("min_length", 2), ("min_aspect", 1.0)),
                  wavefront=(("thr_trunk", -540.0), ("hu_abs_max", -490.0)))
    return xyz(segment(stored(spark, d), cfg))


# --- tiles -----------------------------------------------------------------------------------

@query
def q_tile_starts(spark, d):
    return T.tile_grid(volume(spark, d).where("z = 0").select("case_id", *DIMS), PATCH, STRIDE)


@query
def q_overlap_avg(spark, d):
    vox = voxels(spark, d)
    out = T.overlap_average(vox, PATCH, STRIDE, lambda lx, ly, lz: (lx + 2 * ly + 4 * lz) / 64.0)
    return out.select(*XYZ, "hits", F.round("prob", 9).alias("prob"))


def _ramp(tensor):
    """Deterministic stand-in model: the second logit follows the input and the tile position."""
    import numpy as np
    pos = np.indices(tensor.shape[2:]).astype(np.float64)
    l1 = tensor[:, 0].astype(np.float64) * 4 + (pos[0] + 2 * pos[1] + 4 * pos[2]) / 16.0 - 2
    return np.stack([np.zeros_like(l1), l1], axis=1)


@query
def q_score_tiles(spark, d):
    out = T.score_tiles(volume(spark, d), _ramp, PATCH, STRIDE, *UNIT)
    return to_voxels(out, "prob").select(*XYZ, F.col("prob").cast("double").alias("prob"))


def _channels(tensor):
    import numpy as np
    l1 = tensor[:, 0].astype(np.float64) + 2 * tensor[:, 1] - tensor[:, 2]
    return np.stack([np.zeros_like(l1), l1], axis=1)


@query
def q_score_slices(spark, d):
    out = T.score_slices(volume(spark, d), _channels, 8, 16, *UNIT)
    return to_voxels(out, "prob").select(*XYZ, F.col("prob").cast("double").alias("prob"))


# --- case analytics --------------------------------------------------------------------------

def log_lines(spark, d):
    """Case metrics printed as run logs; numbers are formatted from integers."""
    t = F.floor(F.col("total_s") * 1000).cast("long")
    s = F.round(F.col("dice") * 10000).cast("long")

    def fixed(v, digits):
        unit = 10 ** digits
        return F.concat(F.floor(v / unit).cast("string"), F.lit("."), F.lpad((v % unit).cast("string"), digits, "0"))

    text = F.concat(F.lit("[load] dims=8x8x"), (F.col("case_id") + 1).cast("string"),
                    F.lit("\n[dice] pred="), F.col("n").cast("string"), F.lit(" gt="), (F.col("n") + 7).cast("string"),
                    F.lit(" inter=1  Dice="), fixed(s, 4),
                    F.lit("\n\n=== Timing (s) ===\n  load        : "), fixed(F.floor(t / 8).cast("long"), 3),
                    F.lit("\n  onnx infer  :   "), fixed(F.floor(t / 2).cast("long"), 3),
                    F.lit("\n  TOTAL       :   "), fixed(t, 3), F.lit("\n"))
    return case_metrics(spark, d).select("case_id", "series", text.alias("text"))


@query
def q_log_extract(spark, d):
    return logs.parse_logs(log_lines(spark, d), ["case_id", "series"]).select(
        "case_id", "series", "nz", "dice", "pred_voxels", "gt_voxels", "load_s", "infer_s", "total_s")


@query
def q_ablation(spark, d):
    parsed = logs.parse_logs(log_lines(spark, d), ["case_id", "series"])
    return logs.ablation_means(parsed, "series").select(
        "series", *[F.round(c, 8).alias(c) for c in ("mean_infer_s", "mean_total_s", "mean_dice")])


@query
def q_monitor_stats(spark, d):
    q = F.col("l_quantity").cast("int")
    line = F.concat_ws("   ", F.lit(" 12:00:00"), F.col("l_linenumber").cast("string"),
                       F.when(q % 7 == 0, "-").otherwise(q.cast("string")), (q * 2).cast("string"))
    lines = table(spark, d, "lineitem").select(F.when(q == 1, "# gpu sm mem").otherwise(line).alias("value"))
    return logs.monitor_stats(lines).select(*[F.round(c, 6).alias(c) for c in ("sm_mean", "sm_max", "mem_mean")])


@query
def q_paired_cases(spark, d):
    return S.shared_cases(case_metrics(spark, d)).groupBy("case_id").pivot("series", ["A", "N", "R"]).agg(F.max("dice")) \
        .withColumnsRenamed({"A": "dice_A", "N": "dice_N", "R": "dice_R"})


@query
def q_case_summary(spark, d):
    return S.case_summary(case_metrics(spark, d), 0.95).select(
        "series", "n", F.round("mean_dice", 8).alias("mean_dice"), F.round("median_dice", 6).alias("median_dice"),
        "n_below", "n_ok")


@query
def q_timing_ci(spark, d):
    return S.timing_ci(case_metrics(spark, d)).select(
        "series", "n", *[F.round(c, 6).alias(c) for c in ("mean_s", "std_s", "min_s", "max_s", "lo_s", "hi_s")])


@query
def q_stage_breakdown(spark, d):
    m = case_metrics(spark, d)
    t = F.col("total_s")
    stages = m.select("series", t, (t / 8).alias("load_s"), (t / 2).alias("infer_s"), (t / 4).alias("region_grow_s"))
    return S.stage_breakdown(stages, ["load_s", "infer_s", "region_grow_s"]).select(
        "series", "stage", F.round("mean_s", 6).alias("mean_s"), F.round("share", 6).alias("share"))


@query
def q_slope_origin(spark, d):
    return S.slope_origin(case_metrics(spark, d), F.col("n").cast("double"), F.col("total_s")).select(
        "series", F.round("slope", 6).alias("slope"))


@query
def q_voxel_cost(spark, d):
    return S.voxel_cost(case_metrics(spark, d), volume(spark, d).where("z = 0").select("case_id", *DIMS)).select(
        "series", F.round("ns_per_voxel", 3).alias("ns_per_voxel"))


@query
def q_throughput(spark, d):
    return S.throughput(case_metrics(spark, d)).select(
        "series", "n", F.round("wall_s", 6).alias("wall_s"), F.round("per_s", 9).alias("per_s"))


@query
def q_speedup(spark, d):
    return S.relative_to_first(case_metrics(spark, d), "series", "case_id", "total_s").select(
        "series", "case_id", *[F.round(c, 6).alias(c) for c in ("total_s", "speedup", "change_pct")])


@query
def q_cliffs_delta(spark, d):
    return S.cliffs_delta(S.paired(case_metrics(spark, d))).withColumn("delta", F.round("delta", 9))


@query
def q_rank_biserial(spark, d):
    return S.signed_rank(S.paired(case_metrics(spark, d))).select(
        "pair", "n", "w_pos", "w_neg", F.round("rank_biserial", 9).alias("rank_biserial"))


@query
def q_wilcoxon(spark, d):
    return S.wilcoxon(S.paired(case_metrics(spark, d))).select(
        "pair", "n", "w", F.round("z", 6).alias("z"), F.round("p", 5).alias("p"))


@query
def q_wilcoxon_exact(spark, d):
    """Ten strata of cases, few enough for the exact distribution where nothing ties."""
    pairs = S.paired(case_metrics(spark, d)).withColumn("pair", F.concat_ws(" #", "pair", (F.col("case_id") % 10).cast("string")))
    return S.wilcoxon_auto(pairs).select("pair", "n", "w", "exact", F.round("p", 5).alias("p"))


@query
def q_failed_sets(spark, d):
    return S.failed_sets(case_metrics(spark, d), 0.95)


@query
def q_pair_semi(spark, d):
    return S.pair_semi(table(spark, d, "documents").select("doc_id", "lang", "source"),
                       table(spark, d, "labels"), "doc_id")


@query
def q_training_best(spark, d):
    return S.best_so_far(case_metrics(spark, d).select("series", "case_id", "dice"), "case_id", "dice", "series", 16)


@query
def q_early_stop(spark, d):
    return S.early_stop(case_metrics(spark, d).select("series", "case_id", "dice"), "case_id", "dice", "series", 12, width=16)


def index(spark, d):
    return S.slice_index(volume(spark, d), truth(spark, d).where("x1 - x0 >= 2"))


@query
def q_slice_index(spark, d):
    return index(spark, d)


@query
def q_bg_sample(spark, d):
    return S.background_sample(index(spark, d), 0.3, 5)
