"""Parameters that change results, with their defaults."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields, replace

DAY_MS = 86_400_000


@dataclass(frozen=True)
class Params:
    # association score
    w_entity: float = 0.20
    w_topic: float = 0.10
    w_goal: float = 0.12
    w_event: float = 0.10
    w_temporal: float = 0.10
    w_causal: float = 0.10
    w_emotion: float = 0.05
    w_importance: float = 0.02
    w_context: float = 0.03
    w_lexical: float = 0.18
    w_binary: float = 0.10
    multi_dim_bonus: float = 0.15
    multi_dim_min: int = 3
    cold_start: int = 500
    cold_penalty: float = 0.60
    edge_min: float = 0.25
    observe_max: float = 0.55
    max_candidates: int = 30
    # recall
    per_channel: int = 20
    bm25_norm: float = 2.0
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    rrf_k: float = 1.0
    channel_weights: dict = field(default_factory=lambda: {"TopicCluster": 0.3, "TemporalNeighbor": 0.3})
    # energy
    a_query: float = 0.40
    b_context: float = 0.20
    c_importance: float = 0.60
    d_freshness: float = 0.15
    e_reliability: float = 0.10
    energy_cap: float = 1.0
    hop_decay: float = 0.55
    min_energy: float = 0.05
    fan_out: int = 6
    max_hops: int = 2
    merge_secondary: float = 0.30
    # corrections
    context_alpha: float = 0.5
    coverage_beta: float = 0.2
    # learning
    hebbian_rate: float = 0.08
    hebbian_cap: float = 5.0
    pair_min: float = 3.0
    pair_window_ms: int = 3_600_000
    floor: float = 0.12
    half_life_ms: int = DAY_MS
    max_doublings: int = 6
    max_degree: int = 64
    path_delta: float = 0.25
    recent_bound: int = 16
    idle_factor: float = 0.97
    stale_ms: int = 30 * DAY_MS
    fallback: int = 50
    # compatibility: replay the whole activation log in each cycle, name co-activation edges Causal
    replay_log: bool = False
    causal_coactivation: bool = False
    # summaries
    cluster_min: int = 12
    cluster_jaccard: float = 0.7
    cluster_low_importance: float = 0.5
    summary_confidence: float = 0.35


DEFAULT = Params()


def from_environment(p: Params = DEFAULT, prefix: str = "ASSOCSPARK__") -> Params:
    """p with the numbers and flags that variables such as ASSOCSPARK__MAX_HOPS name; an unknown name is an error."""
    kinds = {f.name: type(getattr(p, f.name)) for f in fields(p)}
    found = {k[len(prefix) :].lower(): v for k, v in os.environ.items() if k.startswith(prefix)}
    unknown = [k for k in found if kinds.get(k) not in (int, float, bool)]
    if unknown:
        raise ValueError(f"no such parameter: {', '.join(unknown)}")
    return replace(p, **{k: v.lower() in ("1", "true", "yes") if kinds[k] is bool else kinds[k](v) for k, v in found.items()})


#: How much of its energy an edge type passes on.
TYPE_MODIFIER = {
    "Causal": 1.30,
    "Correction": 1.20,
    "Supersedes": 1.15,
    "SameGoal": 1.10,
    "SameEvent": 1.10,
    "CoActivation": 1.05,
    "EntityOverlap": 1.00,
    "Elaboration": 1.00,
    "SemanticSimilar": 0.90,
    "TopicRelated": 0.85,
    "EmotionalResonance": 0.70,
    "TemporalAdjacent": 0.60,
    "Contradiction": 0.50,
    "Deprecated": 0.40,
}
PROTECTED = ("Causal", "Correction", "Contradiction", "Supersedes")
POSITIVE_SIGNALS = ("Referenced", "UserConfirmedCorrect", "TaskSucceeded")
#: Change of a memory's usage by a signal, and its weight as a co-activation.
USAGE_DELTA = {"Referenced": 0.05, "UserConfirmedCorrect": 0.10, "TaskSucceeded": 0.08, "UserRejected": -0.10}
SIGNAL_WEIGHT = {"retrieve": 0.5, "Referenced": 0.8, "UserConfirmedCorrect": 1.0, "TaskSucceeded": 1.0}
