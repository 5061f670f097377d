"""Tunable parameters of the operators, validated when built.

Fixed values: the defaults of RiskStateConfig, AltRiskConfig, PolicyConfig, FusionConfig, VideoConfig, RoiDensityConfig, MilConfig,
FallConfig, ForestConfig and CrashConfig are those that results are compared with.
"""

from __future__ import annotations

from dataclasses import dataclass

from .constants import FRAME_HEIGHT, FRAME_WIDTH


@dataclass(frozen=True)
class RiskStateConfig:
    """Smoothing, thresholds and hold times of the severity state machine."""

    ema_alpha: float = 0.35
    warn_up: float = 0.55
    warn_down: float = 0.45
    critical_up: float = 0.8
    critical_down: float = 0.65
    to_warn_hold_ms: int = 1200
    to_critical_hold_ms: int = 900
    to_info_hold_ms: int = 2000
    to_warn_from_critical_hold_ms: int = 1500
    min_change_interval_ms: int = 1200
    slope_eps: float = 0.05
    clamp_to_unit: bool = True

    def __post_init__(self):
        if not 0 < self.ema_alpha <= 1:
            raise ValueError("ema_alpha must be in (0, 1]")
        if self.warn_down >= self.warn_up:
            raise ValueError("warn_down must be below warn_up")
        if self.critical_down >= self.critical_up:
            raise ValueError("critical_down must be below critical_up")


@dataclass(frozen=True)
class AltRiskConfig:
    """Confidence-aware smoothing with immediate two-threshold hysteresis."""

    density_weight: float = 0.65
    anomaly_weight: float = 0.35
    smoothing: float = 0.7
    warn_on: float = 0.55
    warn_off: float = 0.45
    critical_on: float = 0.78
    critical_off: float = 0.68


@dataclass(frozen=True)
class PolicyConfig:
    rising_warn_slope: float = 0.10
    rising_critical_slope: float = 0.15
    penalty_info: float = 1.0
    penalty_warn: float = 1.8
    penalty_critical: float = 3.0
    reroute_on_warn: bool = True
    reroute_on_critical: bool = True
    zone_name_prefix: str = "Zone "


@dataclass(frozen=True)
class FusionConfig:
    paper_weight: float = 0.65
    mil_weight: float = 0.25
    alpha_prev: float = 0.7
    density_weight: float = 0.60
    motion_weight: float = 0.40
    speed_weight: float = 0.40
    turbulence_weight: float = 0.40
    entropy_weight: float = 0.20


@dataclass(frozen=True)
class VideoConfig:
    """How videos are looked at: rates, detector, and frame size."""
    source_fps: float = 25.0
    target_fps: float = 3.0
    detect_every: int = 3
    clip_len: int = 16
    start_ts_ms: int = 0
    flow_within: int | None = None          # frames; None: any age
    labels: tuple | None = ("person",)      # None: all
    detector_available: bool = True
    width: int = FRAME_WIDTH
    height: int = FRAME_HEIGHT

    def __post_init__(self):
        if self.source_fps <= 0 or self.clip_len < 1:
            raise ValueError("source_fps and clip_len must be positive")


@dataclass(frozen=True)
class RoiDensityConfig:
    roi: tuple
    avg_height_m: float = 1.70
    ema_alpha: float = 0.20
    min_samples: int = 3
    min_h_px: float = 35.0
    max_h_px: float = 520.0
    head_to_body_ratio: float = 7.0
    head_spacing_to_body_ratio: float = 2.8
    init_scale_px_per_m: float | None = None

    def __post_init__(self):
        if len(self.roi) < 4:
            raise ValueError("ROI must have at least 4 points")


@dataclass(frozen=True)
class MilConfig:
    margin: float = 1.0
    topk_ratio: float = 0.1
    lambda_sparsity: float = 8e-5
    lambda_smoothness: float = 8e-5


@dataclass(frozen=True)
class FallConfig:
    freefall_g: float = 0.45
    impact_g: float = 2.2
    impact_window_ms: int = 2200
    immobile_ms: int = 10_000
    give_up_ms: int = 16_000
    movement_g: float = 0.16
    prompt_timeout_ms: int = 15_000


@dataclass(frozen=True)
class ForestConfig:
    trees: int = 300
    sample_rows: int = 256
    contamination: str | float = "auto"
    seed: int = 42
    max_rows_per_dataset: int = 0      # 0: no cap
    max_total_rows: int = 0

    def __post_init__(self):
        c = self.contamination
        if c != "auto" and not (isinstance(c, (int, float)) and 0 < c <= 0.5):
            raise ValueError("contamination must be 'auto' or in (0, 0.5]")


@dataclass(frozen=True)
class CrashConfig:
    sample_fps: float = 5.0
    window_sec: float = 2.0
    threshold: float = 0.5

    @property
    def frames_per_window(self) -> int:
        return max(4, round(self.sample_fps * self.window_sec))
