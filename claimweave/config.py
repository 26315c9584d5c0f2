"""Settings of a run: defaults, a mapping (from a file, say), then the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Config:
    """Numbers that operators take as parameters; each can be set by CLAIMWEAVE_ and its name in capitals."""

    papers_per_query: int = 50
    papers_per_cycle: int = 50
    queries_per_cycle: int = 10
    penalty: float = 1.0
    fuzzy_ratio: float = 0.92
    snippet_ratio: float = 0.75
    verify_from: float = 0.55
    chunk_chars: int = 6000
    chunk_overlap: int = 200
    second_source: bool = True
    conflicts_per_cycle: int = 20
    targeted_per_cycle: int = 12

    @classmethod
    def load(cls, given: Mapping[str, object] | None = None, environment: Mapping[str, str] | None = None) -> Config:
        """Unknown names in ``given`` are refused; numbers are read as such, truth as 1, true or yes."""
        environment = os.environ if environment is None else environment
        names = {f.name: f.type for f in fields(cls)}
        if unknown := set(given or {}) - set(names):
            raise KeyError(f"unknown settings: {sorted(unknown)}")
        values = dict(given or {}) | {n: environment[key] for n in names if (key := f"CLAIMWEAVE_{n.upper()}") in environment}
        read = {"int": int, "float": float, "bool": lambda x: str(x).lower() in ("1", "true", "yes")}
        return cls(**{n: read[names[n]](v) for n, v in values.items()})
