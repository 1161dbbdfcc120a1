"""Operator settings: one immutable value, with an own name for each in the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields


@dataclass(frozen=True)
class Settings:
    """Defaults, each of which STEPSCOPE_<NAME> in the environment replaces."""

    drift_threshold: float = 0.35
    reflection_step_interval: int = 5
    max_subgoal_steps: int = 10
    similarity_threshold: float = 0.82
    category_thresholds: Mapping[str, float] = field(default_factory=dict)
    block_on_critical: bool = False

    @classmethod
    def from_env(cls, env: Mapping[str, str] = os.environ) -> Settings:
        """Settings named in the environment; mappings are set in code only."""
        given = {}
        for f in fields(cls):
            text = env.get(f"STEPSCOPE_{f.name.upper()}")
            if text is not None and f.type in READ:
                given[f.name] = READ[f.type](text)
        return cls(**given)


READ = {
    "float": float,
    "int": int,
    "bool": lambda text: text.strip().lower() in ("true", "yes", "on", "1"),
}
