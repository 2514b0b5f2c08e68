"""Whole segmentations: a preset decides which operators are composed.

Input slices carry ``data`` (HU) and, for presets that use a model, ``prob``.  The
result is a run mask.  Per-case branches (abort, revert, rescue, swap) are data:
every case takes part in one plan and its summary row says which mask it keeps.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.functions.voxel import above, clamp, in_band
from voxloom.operators.grow import (SPAN, gate_components, hybrid_grow, interior2d, interior3d, intersect,
                                    pyramid_constraint, seeded)
from voxloom.operators.lut import LutSpec, lut_apply
from voxloom.operators.measure import body_bbox, dice
from voxloom.operators.resample import resampled_size, trilinear
from voxloom.operators.rescue import rescue_sweep
from voxloom.operators.runs import cells, dilate, painted, slice_runs, to_runs, voxel_count
from voxloom.operators.seeds import axis_seeds, axis_seeds_robust
from voxloom.operators.stencils import at, gaussian, gradient_magnitude, positions, vesselness
from voxloom.operators.tiles import Scorer, score_slices, score_tiles
from voxloom.operators.wavefront import wavefront_grow
from voxloom.plans.presets import SegmentConfig
from voxloom.plans.rules import decide
from voxloom.session import attach, cut
from voxloom.sources.tables import DIMS, to_slices

KEYS = ("case_id",)


def with_model(slices: DataFrame, cfg: SegmentConfig, scorer: Scorer) -> DataFrame:
    """Add the probability slice ``prob`` from a tile or slice model.

    With a target spacing (needs ``dx, dy, dz`` on the slices) the volume is resampled
    for the model and the probabilities are resampled back to the stored grid.
    """
    if all(s > 0 for s in cfg.spacing):
        size = tuple(resampled_size(F.col(f"n{a}"), F.col(f"d{a}"), s) for a, s in zip("xyz", cfg.spacing))
        model_grid = to_slices(trilinear(slices, size))
        scored = score_tiles(model_grid, scorer, cfg.patch, cfg.stride, cfg.model_hu_lo, cfg.model_hu_hi, batch=cfg.batch)
        native = slices.where("z = 0").select("case_id", *[F.col(d).alias(f"to_{d}") for d in DIMS])
        back = trilinear(attach(scored, native, ["case_id"]), tuple(F.col(f"to_{d}") for d in DIMS))
        scored = to_slices(back)
    elif cfg.slice_model:
        scored = score_slices(slices, scorer, batch=cfg.batch, lo=cfg.model_hu_lo, hi=cfg.model_hu_hi)
    else:
        scored = score_tiles(slices, scorer, cfg.patch, cfg.stride, cfg.model_hu_lo, cfg.model_hu_hi, batch=cfg.batch)
    return slices.join(scored.select("case_id", "z", F.col("data").alias("prob")), ["case_id", "z"])


def clamped(slices: DataFrame, cfg: SegmentConfig) -> DataFrame:
    return slices.withColumn("data", F.transform("data", lambda v: clamp(v, cfg.hu_min, cfg.hu_max)))


def _confident(slices: DataFrame, cfg: SegmentConfig) -> DataFrame:
    return slice_runs(slices, cells(lambda p: above(p, cfg.model_thr), "prob"))


def _candidate(slices: DataFrame, cfg: SegmentConfig, lut: DataFrame | None) -> DataFrame:
    smooth = gaussian(slices, cfg.radius, cfg.sigma)
    if cfg.lut and lut is None:
        raise ValueError("this configuration looks voxels up in a trained table; give it one")
    if cfg.lut:
        vox = lut_apply(gradient_magnitude(smooth, "smoothed"), lut, LutSpec())
        return to_runs(vox.where(F.col("p") >= cfg.prob_thresh))
    return slice_runs(smooth, cells(lambda v: in_band(v, cfg.band_lo, cfg.band_hi), "smoothed"))


def _size(mask: DataFrame, name: str) -> DataFrame:
    return voxel_count(mask).withColumnRenamed("voxels", name)


def segment(slices: DataFrame, cfg: SegmentConfig, lut: DataFrame | None = None) -> DataFrame:
    """Run mask of every case under one configuration."""
    slices = clamped(slices, cfg)
    hu = positions(slices, ["data"], list(KEYS)).withColumnRenamed("value", "hu")
    bbox = cut(body_bbox(hu, cfg.body_thr, cfg.roi_margin)) if cfg.use_roi else None
    if cfg.components_only and cfg.hybrid:
        return hybrid_grow(slices, bbox, cfg.hybrid_params())
    if cfg.components_only:
        return gate_components(slices, bbox, cfg.gate_params())
    if not cfg.pyramid and not cfg.prob_hardset:
        full = _candidate(slices, cfg, lut)
        inner = interior2d(full, bbox) if cfg.use_roi else interior3d(full)
        mask = seeded(inner, axis_seeds(inner, bbox))
        return _after_growth(slices, bbox, mask, None, cfg)
    if cfg.pyramid:
        envelope = cut(pyramid_constraint(slices, cfg.pyramid_params()))
        core = cut(intersect(_candidate(slices, cfg, lut), envelope))
    else:
        core = cut(_confident(slices, cfg))
        envelope = dilate(core, 3)
    pick = axis_seeds_robust if cfg.guards else axis_seeds
    seeds = cut(pick(core, bbox))
    anchored = cut(seeded(core, seeds))
    if not cfg.vessel:
        return _after_growth(slices, bbox, anchored, None, cfg)
    marks = painted([core, envelope])
    if cfg.prob_score or cfg.prob_hardset:
        scored = positions(slices.join(marks, [*KEYS, "z"], "left"), ["data", "prob", "marks"], list(KEYS)).select(
            *KEYS, "x", "y", "z", *DIMS, F.col("value").alias("hu"), at("prob").alias("vness"), at("marks").alias("_in"))
    else:
        scored = vesselness(slices, incremental=cfg.incremental_scales, carry=True, marks=marks)
    inside = F.coalesce("_in", F.lit(0))
    marked = scored.select("*", (inside.bitwiseAND(1) > 0).alias("hard"), (inside.bitwiseAND(2) > 0).alias("roi")).drop("_in")
    grown = to_runs(wavefront_grow(marked, seeds, cfg.wavefront_params())).select(*KEYS, *SPAN)
    return _after_growth(slices, bbox, cut(grown), anchored if cfg.guards else None, cfg)


def _rescued(slices: DataFrame, bbox: DataFrame | None, cases: DataFrame, cfg: SegmentConfig) -> DataFrame:
    """Re-grow the given cases from a tube found by the threshold sweep."""
    weak = slices.join(cases, list(KEYS), "left_semi")
    found, seeds = rescue_sweep(weak, bbox, cfg.rescue_params())
    loose = slice_runs(attach(weak, found.select(*KEYS, "thr"), list(KEYS)),
                       cells(lambda v: v <= F.col("thr") + F.lit(cfg.rescue_slack), "data"))
    inner = interior2d(loose, bbox)
    return seeded(inner, seeds.unionByName(axis_seeds(inner, bbox)))


def _after_growth(slices: DataFrame, bbox: DataFrame | None, grown: DataFrame,
                  pyramid: DataFrame | None, cfg: SegmentConfig) -> DataFrame:
    """Safety revert, rescue and model swap: one summary row per case picks the mask."""
    params = cfg.safety_params()
    masks = {"wavefront": grown}
    if pyramid is not None:
        masks["pyramid"] = pyramid
    cases = slices.where("z = 0").select(*KEYS)
    summary = cases
    for name, mask in masks.items():
        summary = summary.join(_size(mask, name), list(KEYS), "left")

    def filled(df: DataFrame) -> DataFrame:
        for name in ("wavefront", "pyramid", "rescue", "anchored"):
            df = df.withColumn(name, F.coalesce(name, F.lit(0)) if name in df.columns else F.lit(0).cast("long"))
        return df

    if not cfg.guards:
        params = replace(params, pyramid_floor=2**62)
    if not cfg.anchored_swap:
        params = replace(params, swap_floor=2**62)
    elif not cfg.rescue_aware_swap:
        params = replace(params, swap_rescue_ratio=float(2**40))
    if not cfg.rescue:
        params = replace(params, rescue_min=0)
    summary = cut(filled(summary))
    if cfg.rescue:
        weak = decide(summary, params).where(F.col("final_voxels") < cfg.rescue_min).select(*KEYS)
        masks["rescue"] = cut(_rescued(slices, bbox, cut(weak), cfg))
        summary = summary.drop("rescue").join(_size(masks["rescue"], "rescue"), list(KEYS), "left")
    if cfg.anchored_swap:
        hard = cut(_confident(slices, cfg))
        masks["anchored"] = cut(seeded(hard, axis_seeds_robust(hard, bbox), hard))
        summary = summary.drop("anchored").join(_size(masks["anchored"], "anchored"), list(KEYS), "left")
    if len(masks) == 1:
        return grown
    picked = cut(decide(filled(summary), params).select(*KEYS, "source"))
    parts = [m.select(*KEYS, *SPAN).join(picked.where(F.col("source") == name), list(KEYS), "left_semi")
             for name, m in masks.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def score(mask: DataFrame, truth: DataFrame, dims: DataFrame | None = None,
          truth_dims: DataFrame | None = None) -> DataFrame:
    """Overlap per case; cases whose grids differ are left out, not mis-scored.

    With the grid sizes of the cases (``dims``) also cases that are empty in both masks get their row.
    """
    cases = None if dims is None else dims.select("case_id").distinct()
    if dims is not None and truth_dims is not None:
        cases = dims.join(truth_dims, ["case_id", *DIMS], "left_semi").select("case_id").distinct()
        mask, truth = (m.join(cases, "case_id", "left_semi") for m in (mask, truth))
    return dice(mask, truth, cases=cases)
