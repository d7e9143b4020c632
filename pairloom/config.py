"""Settings as frozen dataclasses; unknown and missing keys are errors."""

from __future__ import annotations

from dataclasses import MISSING, dataclass, field, fields
from typing import Any


def strict(cls, values: dict[str, Any]):
    """``cls`` from a mapping with exactly its keys; those with defaults may be left out."""
    known = {f.name for f in fields(cls)}
    need = {f.name for f in fields(cls) if f.default is MISSING and f.default_factory is MISSING}
    if set(values) - known or need - set(values):
        raise ValueError(f"{cls.__name__}: unknown {sorted(set(values) - known)}, missing {sorted(need - set(values))}")
    return cls(**values)


@dataclass(frozen=True)
class StreamSpec:
    name: str
    root: str
    anchor_column: str
    positive_column: str
    parquet: str = "**/*.parquet"
    weight: float = 1.0
    language_id: str | None = None
    path_component: int | None = None
    language_map: dict[str, str] = field(default_factory=dict)
    anchor_language: str | None = None
    temperature: float | None = None
    max_languages: int | None = None
    include: tuple[str, ...] | None = None
    exclude: tuple[str, ...] = ()


@dataclass(frozen=True)
class StreamSettings:
    seed: int = 0
    max_chars: int = 512
    batch_size: int = 2048
    fragment_rows: int = 2048
    source_temperature: float = 1.0
    language_temperature: float = 1.0
    holdout_row_groups: int = 0
    start_batch: int = 0


@dataclass(frozen=True)
class DiscoverySettings:
    budget: int = 32_768
    candidate_capacity: int = 131_072
    top_per_forward: int = 4_096
    min_support: int = 32
    per_language_quota: int = 1_024
    per_language_min_support: int = 8
    min_utility: float = 0.0
    promotion_step: int = 1_000

    def __post_init__(self):
        if not 0 < self.budget <= self.candidate_capacity:
            raise ValueError("0 < budget <= candidate_capacity")
        if min(self.top_per_forward, self.min_support, self.promotion_step) < 1 or self.per_language_quota < 0:
            raise ValueError("thresholds must be positive")


def language_indices(languages: list[str], trained: list[str] | None = None) -> list[int]:
    """Indices of the ``trained`` among a model's languages, in the model's order; all without a list, an error for one it lacks."""
    if len(set(languages)) < len(languages):
        raise ValueError("a language comes twice")
    unknown = set(trained or ()) - set(languages)
    if unknown:
        raise ValueError(f"unknown languages {sorted(unknown)}")
    return [i for i, x in enumerate(languages) if trained is None or x in set(trained)]


def promotion_step(settings: DiscoverySettings, max_steps: int) -> int | None:
    """The step at which a run promotes: within the run, or None for one that only discovers, whose step is the one after its last."""
    if not 0 < settings.promotion_step <= max_steps + 1:
        raise ValueError(f"promotion at step {settings.promotion_step} of {max_steps}")
    return settings.promotion_step if settings.promotion_step <= max_steps else None


def parse_roots(assignments: list[str]) -> dict[str, str]:
    """``NAME=PATH`` arguments; a name that comes twice is an error."""
    out: dict[str, str] = {}
    for a in assignments:
        name, _, path = a.partition("=")
        if not name or not path or name in out:
            raise ValueError(f"bad or repeated root {a!r}")
        out[name] = path
    return out


def load_yaml(path: str, required: tuple[str, ...] = ("run_name", "streams", "streaming", "training")) -> dict:
    import yaml  # an optional library

    with open(path) as f:
        config = yaml.safe_load(f)
    missing = [k for k in required if k not in config]
    if missing:
        raise ValueError(f"{path}: missing {missing}")
    return config
