"""Thresholds of both rule sets, in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class PauseRules:
    """Pause and retreat thresholds (frame-rate rule set)."""

    speed: float = 0.035
    retreat: float = 0.035
    back_foot: float = 0.05
    y_variance: float = 0.0012
    min_frames: int = 8
    scaled: bool = True
    base_fps: float = 15.0
    min_fps: float = 0.1

    def per_frame(self, value: float, fps: float) -> float:
        """A per-frame threshold at this frame rate."""
        if not self.scaled:
            return value
        return value * (self.base_fps / (fps if fps >= self.min_fps else self.base_fps))


# The older rule set, not scaled by frame rate.
BASE_PAUSES = PauseRules(speed=0.03, retreat=0.03, back_foot=0.05, y_variance=0.001, min_frames=4, scaled=False)


@dataclass(frozen=True)
class LungeRules:
    """Lunge thresholds."""

    core: float = 1.0
    expand: float = 0.9
    min_frames: int = 5
    backward: float = 0.08
    max_backward_share: float = 0.30
    late_hit_gap: int = 15
    hit_grace: int = 2
    hip_angle: float = 125.0
    hip_frames: int = 2
    far: float = 1.2
    far_frames: int = 2
    late_pause_frames: int = 2
    late_pause_window: int = 4
    response_buffer: int = 6


@dataclass(frozen=True)
class ArmRules:
    """Arm extension thresholds."""

    reach: float = 0.45
    min_frames: int = 2
    max_hit_gap: int = 8
    straight_deg: float = 140.0
    overlong_frames: int = 17
    early_end_gap: int = 8
    body_angle_deg: float = 70.0
    response_buffer: int = 6


@dataclass(frozen=True)
class ContactRules:
    """Blade contact classifiers."""

    wrist_forward: float = 13.0
    wrist_speed: float = 820.0
    pre_weight: float = -1.0
    post_weight: float = 0.75
    threshold: float = 0.14
    legacy_pre_weight: float = 1.5
    legacy_threshold: float = -0.08
    margin: float = 0.08
    high_margin: float = 0.16
    scale: float = 0.08


@dataclass(frozen=True)
class Rules:
    """Everything the phrase decision uses."""

    pause: PauseRules = PauseRules()
    lunge: LungeRules = LungeRules()
    arm: ArmRules = ArmRules()
    contact: ContactRules = ContactRules()
    slow_start_frame: int = 10
    slow_start_seconds: float = 0.5
    overlap_seconds: float = 1.0
    overlap_share: float = 0.5
    overlap_end_gap: int = 6
    arm_weight: float = 0.6
    lunge_weight: float = 0.4
    contact_seconds: float = 1.0
