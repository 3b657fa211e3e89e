"""Every tunable in one place."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import asdict, dataclass, fields, replace


@dataclass(frozen=True)
class Options:
    """Thresholds, limits and switches of the engine; the operators' defaults are these."""

    stage_a_threshold: float = 0.60
    stage_b_threshold: float = 0.50
    min_stage_a: int = 3
    max_results: int = 5
    decoy_confidence_multiplier: float = 0.60
    decoy_similarity_cap: float = 0.45
    prior_success_rate: float = 0.5
    min_history: int = 2
    same_cid_boost: float = 0.32
    cross_cid_penalty: float = 0.22
    action_success_weight: float = 0.12
    topology_neighbor_boost: float = 0.10
    graph_distance_penalty: float = 0.10
    evidence_boost: float = 0.08
    decoy_cap_similarity: float = 0.39
    decoy_cap_remediation: float = 0.39
    window_s: int = 60
    min_incidents: int = 5
    alpha: float = 0.05
    motif_start: float = 0.6
    motif_cap: float = 0.95
    motif_floor: float = 0.1
    motif_decay: float = 0.99
    motif_gain: float = 0.10
    motif_drop: float = 0.15
    motif_keep: int = 100
    use_decoy_suppression: bool = True
    use_two_stage: bool = True
    use_remediation_optimizer: bool = True
    use_family_rep: bool = True


DEFAULT = Options()


def changed(config: Mapping[str, float], base: Options = DEFAULT) -> Options:
    """base with `config` over it; ValueError for an unknown key, a share outside [0, 1], stage B above A or a count below 1."""
    known = {f.name: f.type for f in fields(Options)}
    bad = [k for k in config if k not in known]
    if not bad:
        out = replace(base, **config)
        values = asdict(out)
        bad = [k for k, kind in known.items() if (kind == "float" and not 0 <= values[k] <= 1) or (kind == "int" and values[k] < 1)]
        if not bad and out.stage_b_threshold <= out.stage_a_threshold:
            return out
    raise ValueError(f"bad configuration: {', '.join(bad) or 'stage B above stage A'}")
