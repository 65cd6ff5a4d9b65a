"""Parameters, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class FilterConfig:
    min_overlap_length: int = 2000
    min_overlap_count: int = 3
    min_percent_identity: float = 5.0  # compared in 32 bits
    overhang_ratio: float = 0.8  # rounded to 32 bits, then used in 64


@dataclass(frozen=True)
class GraphConfig:
    max_bubble_length: int = 100
    min_support_ratio: float = 1.1
    max_tip_len: int = 4
    fuzz: int = 10
    cleanup_iterations: int = 2
    short_edge_ratio: float = 0.8
    tip_mode: str = "first"  # or "walk"
    max_component_edges: int | None = None  # of a neighbourhood of bubbles; more is an error
    unitig_order: str = "branch-first"  # or "sequential"
