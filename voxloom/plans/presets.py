"""Named presets and their parameters.

Presets are resolved first and explicit overrides second, whatever the order they
were given in; unknown names are an error.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from voxloom.operators.grow import GateParams, HybridParams, PyramidParams
from voxloom.operators.rescue import RescueParams
from voxloom.operators.wavefront import WavefrontParams
from voxloom.plans.rules import SafetyParams


@dataclass(frozen=True)
class SegmentConfig:
    # inputs, smoothing, body window
    hu_min: float = -1024.0
    hu_max: float = 600.0
    sigma: float = 1.0
    radius: int = 2
    band_lo: float = -1100.0
    band_hi: float = -920.0
    use_roi: bool = True
    body_thr: float = -300.0
    roi_margin: int = 5
    # table look-up instead of the band
    lut: bool = False
    prob_thresh: float = 0.5
    # stages
    pyramid: bool = False
    adaptive: bool = False
    feedback: bool = False
    vessel: bool = False
    guards: bool = False
    rescue: bool = False
    loose: bool = False
    incremental_scales: bool = False
    # model use
    model: bool = False
    slice_model: bool = False
    prob_score: bool = False
    prob_hardset: bool = False
    anchored_swap: bool = False
    rescue_aware_swap: bool = False
    components_only: bool = False
    gate: bool = False
    hybrid: bool = False
    model_thr: float = 0.5
    patch: int = 128
    stride: int = 128
    batch: int = 1
    model_hu_lo: float = -1000.0
    model_hu_hi: float = 600.0
    spacing: tuple[float, float, float] = (0.0, 0.0, 0.0)
    # gate, refinements, hybrid
    gate_ratio: float = 0.5
    gate_lo: float = 0.4
    gate_hi: float = 0.5
    close_margin: int = 0
    relax_envelope: int = 0
    relax_lo: float = 0.3
    core_thr: float = 0.5
    prob_gate: float = 0.1
    hybrid_hu_lo: float = -1000.0
    hybrid_hu_hi: float = -700.0
    abort_ratio: float = 0.8
    # pyramid, wavefront
    dilate: int = 15
    coarse_low: float = -1100.0
    coarse_high: float = -960.0
    core_frac: float = 0.30
    air_k: float = 2.5
    cap_share: float = 0.012
    feedback_step: float = 25.0
    vmin: float = 0.03
    thr_periph: float = -820.0
    max_level: int = 60
    hu_abs_max: float = -750.0
    # safety
    safety_ratio: float = 2.5
    safety_ratio2: float = 1.5
    safety_abs: int = 600_000
    pyramid_floor: int = 80_000
    rescue_min: int = 10_000
    rescue_slack: float = 25.0
    rescue_leak_cap: int = 600_000
    swap_floor: int = 20_000
    swap_ratio: float = 10.0
    swap_rescue_ratio: float = 4.0
    # thresholds of the air statistics and the tube search, for volumes on another scale
    air: tuple[tuple[str, object], ...] = ()
    tube: tuple[tuple[str, object], ...] = ()
    wavefront: tuple[tuple[str, object], ...] = ()

    def gate_params(self) -> GateParams:
        lo, hi = (self.gate_lo, self.gate_hi) if self.gate else (self.model_thr, self.model_thr)
        return GateParams(lo, hi, self.gate_ratio, self.relax_envelope, self.relax_lo, self.model_thr, self.close_margin)

    def hybrid_params(self) -> HybridParams:
        return HybridParams(self.core_thr, self.prob_gate, self.hybrid_hu_lo, self.hybrid_hu_hi, self.abort_ratio)

    def pyramid_params(self) -> PyramidParams:
        return PyramidParams(self.coarse_low, self.coarse_high, self.adaptive, self.feedback, self.guards,
                             self.core_frac, self.air_k, self.body_thr, self.cap_share, self.feedback_step,
                             dilate=self.dilate, air=self.air)

    def wavefront_params(self) -> WavefrontParams:
        base = WavefrontParams(thr_periph=self.thr_periph, vmin=self.vmin, max_level=self.max_level)
        if self.guards and not self.loose:
            base = replace(base, hu_abs_max=self.hu_abs_max, vmin=0.06 if self.vmin == 0.03 else self.vmin,
                           leak_factor=2.0, leak_base=400, leak_ratio=1.5)
        return replace(base, **dict(self.wavefront))

    def safety_params(self) -> SafetyParams:
        return SafetyParams(self.safety_ratio, self.safety_ratio2, self.safety_abs, self.pyramid_floor, self.loose,
                            self.rescue_min, self.rescue_leak_cap, self.swap_floor, self.swap_ratio,
                            self.swap_rescue_ratio)

    def rescue_params(self) -> RescueParams:
        return replace(RescueParams(), **dict(self.tube))


_GUARDED = {"guards": True, "pyramid": True, "adaptive": True, "feedback": True, "vessel": True}
_CLASSICAL = {**_GUARDED, "rescue": True, "loose": True, "rescue_min": 15_000}
_SWAP = {**_CLASSICAL, "incremental_scales": True, "model": True, "prob_score": True, "anchored_swap": True}
_MODEL = {"model": True, "components_only": True, "stride": 96}

# Preset names and what each one switches on.
PRESETS: dict[str, dict[str, object]] = {
    "none": {},
    "pyramid": {"pyramid": True},
    "adaptive": {"adaptive": True},
    "feedback": {"feedback": True},
    "vessel": {"vessel": True},
    "v5": _GUARDED,
    "v6": {**_GUARDED, "rescue": True},
    "v7": _CLASSICAL,
    "v8": {**_CLASSICAL, "incremental_scales": True},
    "classical": {**_CLASSICAL, "incremental_scales": True},
    "v9-1": {**_CLASSICAL, "incremental_scales": True, "model": True, "prob_score": True},
    "v9-2": {"guards": True, "vessel": True, "rescue": True, "loose": True, "rescue_min": 15_000,
             "incremental_scales": True, "model": True, "prob_hardset": True},
    "v10": _SWAP,
    "v11": {**_SWAP, "rescue_aware_swap": True},
    "v12": {**_SWAP, "rescue_aware_swap": True},
    "v13": {**_SWAP, "rescue_aware_swap": True, "stride": 96, "spacing": (0.6, 0.6, 1.0), "swap_ratio": 5.0},
    "v14": _MODEL,
    "v15": {**_MODEL, "model_thr": 0.4},
    "v16": {**_MODEL, "gate": True, "model_thr": 0.5},
    "gate": {**_MODEL, "gate": True, "model_thr": 0.5},
    "v17": {**_MODEL, "hybrid": True},
    "hybrid": {**_MODEL, "hybrid": True},
    "unet25d": {"model": True, "slice_model": True, "components_only": True, "batch": 16, "model_thr": 0.5},
    "model-2p5d": {"model": True, "slice_model": True, "components_only": True, "batch": 16, "model_thr": 0.5},
    "fast": {"stride": 128},
}


def resolve(*presets: str, **overrides: object) -> SegmentConfig:
    known = {f.name for f in fields(SegmentConfig)}
    settings: dict[str, object] = {}
    for name in presets:
        if name not in PRESETS:
            raise ValueError(f"unknown preset {name!r}")
        settings.update(PRESETS[name])
    unknown = set(overrides) - known
    if unknown:
        raise ValueError(f"unknown settings {sorted(unknown)}")
    return SegmentConfig(**{**settings, **overrides})
