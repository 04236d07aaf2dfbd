"""Thresholds and weights of the evidence operators, each a frozen record.

Fixed values: the numbers below are part of the defined results.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class AlignConfig:
    """Matching of recognised regions with layout blocks of a page."""

    w_iou: float = 0.5
    w_vertical: float = 0.3
    w_order: float = 0.1
    w_text: float = 0.1
    order_reach: int = 10
    text_chars: int = 100
    least_iou: float = 0.02
    least_overlap: float = 0.1
    impossible: float = 999.0
    most_cost: float = 0.85
    containment_confidence: float = 0.6


@dataclass(frozen=True)
class DetectConfig:
    """Limits of the disagreement rules."""

    low_confidence: float = 0.30
    completion_ratio: float = 1.20
    least_iou: float = 0.05
    order_gap: int = 2


@dataclass(frozen=True)
class SelectConfig:
    """Models in the order of their reliability, and those that share a family: the caller's to say."""

    reliability: tuple[str, ...]
    family: tuple[str, ...] = ()


@dataclass(frozen=True)
class RecoverConfig:
    """Budgets of repeated recognition of one region."""

    most_variants: int = 2
    low_confidence: float = 0.40
    shrink: float = 0.5
    wall_ms: int = 120_000
    least_angle: float = 1.5
    pad_pixels: int = 4


@dataclass(frozen=True)
class JobConfig:
    stale_seconds: int = 120
    most_seconds: int = 180
    active: tuple[str, ...] = ("queued", "submitted", "running")


ALIGN, DETECT, RECOVER, JOBS = AlignConfig(), DetectConfig(), RecoverConfig(), JobConfig()
