"""Every constant of the engine, as parameters with their usual values."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """Time is an input (`as_of`, epoch seconds): no operator reads a clock."""

    as_of: float = 0.0
    dim: int = 50
    decay_exponent: float = 0.5
    decay_tau: float = 30 * 86400.0
    archive_epsilon: float = 0.01
    consolidation: float = 0.85
    grounding: int = 50
    min_components: int = 2
    episodic_factor: float = 0.7
    object_weight: float = 0.5
    verb_weight: float = 0.2
    self_relation_weight: float = 0.5
    anomaly_min_components: int = 3
    facet_threshold: float = 0.05
    deepen_iterations: int = 3
    deepen_alpha: float = 0.7
    deepen_top_k: int = 30
    deepen_min_mass: float = 0.01
    deepen_max_candidates: int = 200
    deepen_containment: float = 0.1
    edge_threshold: float = 0.3
    graph_top: int = 50
    ego_threshold: float = 0.2
    burst_window: float = 45.0
    burst_min_length: int = 10
    segment_min_length: int = 5
    anomaly_question: float = 0.7
    archive_question: float = 0.5
    contrast_low: float = 0.3
    contrast_high: float = 0.8
    milestone: int = 50


#: Priorities of the question types.
PRIORITIES = {"anomaly": 0.9, "contradiction": 0.85, "defeasible": 0.6, "archive": 0.5, "contrast": 0.3, "milestone": 0.2}
