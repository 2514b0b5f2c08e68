"""Growing compositions shared by the presets: flood removal, gate, hybrid, pyramid."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.functions.voxel import above, in_band
from voxloom.operators.connect import components, lateral_border, touched_labels, without_exterior
from voxloom.operators.measure import adaptive_threshold, gate, hybrid_abort, prune_slices, with_bbox
from voxloom.operators.resample import downsample2
from voxloom.operators.runs import cells, close, cover, dilate, slice_runs, sweep_runs, upsample2, voxel_count
from voxloom.operators.seeds import axis_seeds, axis_seeds_robust
from voxloom.session import attach, cut
from voxloom.sources.tables import DIMS

SPAN = ["z", "y", "x0", "x1", *DIMS]


def union(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    both = a.select(*keys, *SPAN).unionByName(b.select(*keys, *SPAN))
    return cover(both, [*keys, "z", "y"], F.lit(1)).select(*keys, *SPAN)


def intersect(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """Spans set in both masks: covered twice on their line. One shuffle, no join."""
    both = a.select(*keys, *SPAN).unionByName(b.select(*keys, *SPAN))
    return cover(both, [*keys, "z", "y"], F.lit(2)).select(*keys, *SPAN)


def within(vox: DataFrame, runs: DataFrame, flag: str, keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """Mark voxel rows that lie in a run mask (lines meet once; a voxel is in at most one run)."""
    spans = runs.select(*[F.col(k).alias(f"_{k}") for k in (*keys, "z", "y")], F.col("x0").alias("_a"), F.col("x1").alias("_b"))
    same = F.col("x").between(F.col("_a"), F.col("_b"))
    for k in (*keys, "z", "y"):
        same = same & (F.col(k) == F.col(f"_{k}"))
    return vox.join(spans, same, "left").select(*vox.columns, F.col("_a").isNotNull().alias(flag))


def interior2d(runs: DataFrame, bbox: DataFrame | None = None, keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """Per-slice interior: inside the window, not connected in the plane to its edge."""
    windowed = with_bbox(runs, bbox, keys)
    low, high = F.greatest("x0", "bx0"), F.least("x1", "bx1")
    clipped = windowed.where(F.col("y").between(F.col("by0"), F.col("by1"))
                             & F.col("z").between(F.col("bz0"), F.col("bz1")) & (low <= high)) \
        .withColumn("x0", low).withColumn("x1", F.least("x1", "bx1"))
    edge = lateral_border(F.col("bx0"), F.col("bx1"), F.col("by0"), F.col("by1"))
    return without_exterior(clipped, edge, keys, volumetric=False).select(*keys, *SPAN)


def interior3d(runs: DataFrame, keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """Volume interior: not connected to a lateral face (the z faces stay open)."""
    return without_exterior(runs, lateral_border(), keys).select(*keys, *SPAN)


def seeded(runs: DataFrame, seeds: DataFrame, raw: DataFrame | None = None,
           keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """Components with a seed; keys without any seed keep ``raw`` (default: nothing)."""
    labelled = components(runs, keys)
    grown = labelled.join(touched_labels(labelled, seeds, keys), [*keys, "label"], "left_semi").select(*keys, *SPAN)
    if raw is None:
        return grown
    bare = raw.join(seeds.select(*keys).distinct(), list(keys), "left_anti").select(*keys, *SPAN)
    return grown.unionByName(bare)


@dataclass(frozen=True)
class GateParams:
    lo: float = 0.4
    hi: float = 0.5
    ratio: float = 0.5
    relax_margin: int = 0
    relax_lo: float = 0.3
    model_thr: float = 0.5
    close_margin: int = 0


def relaxed_envelope(slices: DataFrame, core: DataFrame, margin: int, lo: float, prob: str = "prob",
                     keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """Core plus the voxels above ``lo`` that lie within ``margin`` of it."""
    loose = slice_runs(slices, cells(lambda p: above(p, lo), prob), keys)
    return union(core, intersect(loose, dilate(core, margin, keys), keys), keys)


def _values(slices: DataFrame, plane: str, keys: tuple[str, ...]) -> DataFrame:
    return slices.select(*keys, F.explode(plane).alias(plane))


def gate_components(slices: DataFrame, bbox: DataFrame | None = None, p: GateParams = GateParams(),
                    prob: str = "prob", keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """Per-key gated threshold, optional refinements, then the centrally seeded components."""
    thr = gate(_values(slices, prob, keys), p.lo, p.hi, p.ratio, prob, keys).select(*keys, "thr")
    core = slice_runs(attach(slices, thr, list(keys)), cells(lambda v: above(v, F.col("thr")), prob), keys)
    if p.relax_margin > 0 and p.relax_lo < p.model_thr:
        core = relaxed_envelope(slices, core, p.relax_margin, p.relax_lo, prob, keys)
    core = cut(close(core, p.close_margin, keys))
    return seeded(core, axis_seeds_robust(core, bbox, keys=keys), core, keys)


@dataclass(frozen=True)
class HybridParams:
    core: float = 0.5
    floor: float = 0.1
    hu_lo: float = -1000.0
    hu_hi: float = -700.0
    abort: float = 0.8


def hybrid_candidate(p: HybridParams, prob: Column, hu: Column, aborted: Column | None = None) -> Column:
    """Confident core, plus uncertain voxels in the HU band unless the key is aborted."""
    loose = above(prob, p.floor) & in_band(hu, p.hu_lo, p.hu_hi)
    return above(prob, p.core) | (loose if aborted is None else (~aborted & loose))


def hybrid_grow(slices: DataFrame, bbox: DataFrame | None = None, p: HybridParams = HybridParams(),
                prob: str = "prob", hu: str = "data", keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """Growth from the core through the uncertain band; aborted keys stay in the core.

    Both branches are one candidate expression, so all keys share one labelling.
    """
    flag = hybrid_abort(_values(slices, prob, keys), p.core, p.floor, p.abort, prob, keys).select(*keys, "abort")
    core = cut(slice_runs(slices, cells(lambda v: above(v, p.core), prob), keys))
    candidate = slice_runs(attach(slices, flag, list(keys)),
                           cells(lambda v, h: hybrid_candidate(p, v, h, F.col("abort")), prob, hu), keys)
    return seeded(candidate, axis_seeds_robust(core, bbox, keys=keys), core, keys)


@dataclass(frozen=True)
class PyramidParams:
    coarse_low: float = -1100.0
    coarse_high: float = -960.0
    adaptive: bool = True
    feedback: bool = True
    keep_best: bool = True
    core_frac: float = 0.30
    air_k: float = 2.5
    body_thr: float = -300.0
    cap_share: float = 0.012
    step: float = 25.0
    tries: int = 9
    dilate: int = 15
    air: tuple[tuple[str, object], ...] = ()


def feedback_trunk(coarse: DataFrame, thr: DataFrame, p: PyramidParams = PyramidParams(),
                   keys: tuple[str, ...] = ("case_id",)) -> tuple[DataFrame, DataFrame]:
    """Coarse trunk of each key under the loosest threshold whose growth stays under the cap.

    All tightening attempts are grown together (attempt number as a second key, runs cut from
    one array a slice); the choice per key is then a small aggregate instead of a loop of jobs.
    Returns (trunk runs, choice per key).
    """
    tries = p.tries if p.feedback else 1
    attempt = (*keys, "attempt")
    tightened = attach(coarse, thr.select(*keys, "thr"), list(keys))
    # A cell takes part in attempt t as long as the threshold, t steps lower, is not under it.
    need = cells(lambda v: F.when(v >= p.coarse_low, -F.floor((F.col("thr") - v) / F.lit(p.step))), "data")
    cand = sweep_runs(tightened, need, {t: -t for t in range(tries)}, "attempt", keys)
    inner = interior2d(cand, None, attempt)
    trunk = cut(seeded(inner, axis_seeds(inner, None, keys=attempt), None, attempt))
    caps = coarse.where("z = 0").select(*keys, F.floor(
        F.lit(p.cap_share) * F.col("nx").cast("long") * F.col("ny") * F.col("nz")).alias("cap"))
    sizes = voxel_count(trunk, attempt).groupBy(*keys).agg(
        *[F.sum(F.when(F.col("attempt") == t, F.col("voxels")).otherwise(0)).alias(f"s{t}") for t in range(tries)])
    size = [F.coalesce(F.col(f"s{t}"), F.lit(0)) for t in range(tries)]
    first_ok = F.lit(None).cast("int")
    for t in reversed(range(tries)):
        first_ok = F.when(size[t] <= F.col("cap"), t).otherwise(first_ok)
    best = F.array_min(F.filter(F.array(*[F.struct(s.alias("s"), F.lit(t).alias("t")) for t, s in enumerate(size)]),
                                lambda e: e["s"] > 0))
    last = best["t"] if p.keep_best else F.lit(tries - 1)
    choice = caps.join(sizes, list(keys), "left").select(
        *keys, "cap", F.coalesce(first_ok, last).cast("int").alias("attempt"),
        F.coalesce(*[F.when(F.coalesce(first_ok, last) == t, size[t]) for t in range(tries)]).alias("voxels"))
    chosen = attach(trunk, choice.select(*keys, F.col("attempt").alias("_pick")), list(keys))
    return chosen.where(F.col("attempt") == F.col("_pick")).select(*keys, *SPAN), choice


def pyramid_constraint(slices: DataFrame, p: PyramidParams = PyramidParams(),
                       keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """Growth envelope found at half resolution: trunk, pruned, dilated, upsampled."""
    coarse = cut(downsample2(slices, keys))
    if p.adaptive:
        thr = adaptive_threshold(slices, p.body_thr, p.air_k, p.core_frac, keys=keys, coarse=coarse, **dict(p.air))
    else:
        thr = coarse.where("z = 0").select(*keys, F.lit(p.coarse_high).alias("thr"))
    trunk, _ = feedback_trunk(coarse, thr, p, keys)
    if p.feedback:
        trunk = prune_slices(trunk, keys)
    wide = dilate(trunk, (p.dilate + 1) // 2, keys)
    fine = coarse.where("z = 0").select(*keys, "fx", "fy", "fz")
    return upsample2(attach(wide, fine, list(keys)), keys)


def pyramid_mask(slices: DataFrame, candidate: DataFrame, bbox: DataFrame | None = None,
                 p: PyramidParams = PyramidParams(), robust: bool = True,
                 keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """Candidate restricted to the envelope, then its centrally seeded components."""
    core = cut(intersect(candidate, pyramid_constraint(slices, p, keys), keys))
    pick = axis_seeds_robust if robust else axis_seeds
    return seeded(core, pick(core, bbox, keys=keys), None, keys)

