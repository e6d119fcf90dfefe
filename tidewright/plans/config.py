"""Run configurations: TOML or JSON files, strict, with hashes that say what a store can be resumed or reused with."""

from __future__ import annotations

import hashlib
import json
import math
import tomllib
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path
from typing import Any

from tidewright.functions import criteria, design, families

ALGORITHM_VERSION = REGISTRY_VERSION = "1"
# The fields that determine a fit, and with the criteria what is derived from it.
FIT_FIELDS = (
    "geometry_hash", "variable", "signal_terms", "objective", "engine", "seed", "registry_version", "algorithm_version",
    "warm_start_enabled", "warm_start_coarse_stride", "warm_start_interpolation_rule", "warm_start_spiral_bound", "warm_start_tie_break",
)
COMPAT_FIELDS = (*FIT_FIELDS, "criteria")
WARM_START = {"enabled": True, "coarse_stride": 8, "interpolation_rule": "nearest_valid", "spiral_bound": 4, "tie_break": "lowest_yx"}


class ConfigError(ValueError):
    """A configuration that cannot be run."""


def canonical(value: Any) -> str:
    """JSON with sorted keys and no blanks; only finite numbers and string keys."""

    def check(x: Any) -> None:
        if isinstance(x, dict):
            if not all(isinstance(k, str) for k in x):
                raise ConfigError("keys of a hashed mapping are strings")
            for v in x.values():
                check(v)
        elif isinstance(x, (list, tuple)):
            for v in x:
                check(v)
        elif isinstance(x, float) and not math.isfinite(x):
            raise ConfigError("only finite numbers are hashed")
        elif x is not None and not isinstance(x, (str, int, float, bool)):
            raise ConfigError(f"{type(x).__name__} is not hashed")

    check(value)
    return json.dumps(value, sort_keys=True, separators=(",", ":"))


def digest(value: Any) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()[:16]


def spec_hash(expression: str) -> str:
    """Identity of a candidate: its terms in canonical order with their parameters."""

    def parameter(kind: str, name: str, fixed: dict[str, float]) -> dict:
        out = {"default": repr(float(fixed.get(name, families.DEFAULTS.get(name, 1.0)))), "limits": [repr(x) for x in families.LIMITS.get(name, (-math.inf, math.inf))]}
        if name in fixed:
            out["fixed"] = True
        if (map_ := families.FAMILIES[kind].bijectors.get(name)) is not None:
            out["map"] = repr(map_)
        return out

    terms = [{"kind": k, "params": {p: parameter(k, p, fixed) for p in families.FAMILIES[k].params}} for k, fixed in families.terms(expression)]
    return digest({"terms": terms})


@dataclass(frozen=True)
class Config:
    """What to read, which models to fit and how to score them."""

    data_uri: str
    variable: str
    signal_terms: tuple[str, ...]
    candidates: tuple[str, ...]
    criteria: tuple[str, ...]
    objective: str = "ml"
    engine: str = "kalman"
    seed: int = 0
    warm_start: dict = field(default_factory=lambda: dict(WARM_START))
    tile_side: int = 16
    max_iter: int = 200
    output: str = "out"

    def __post_init__(self) -> None:
        for name in ("signal_terms", "candidates", "criteria"):
            if not (got := getattr(self, name)) or isinstance(got, str):
                raise ConfigError(f"{name} is a list with at least one entry")
            object.__setattr__(self, name, tuple(got))
        for term in self.signal_terms:
            design.parse(term)
        for c in self.criteria:
            if c not in criteria.CRITERIA:
                raise ConfigError(f"unknown criterion {c!r}; known: {', '.join(criteria.CRITERIA)}")
        if len({spec_hash(c) for c in self.candidates}) < len(self.candidates):
            raise ConfigError("two candidates are the same model")
        if self.objective not in ("ml", "reml"):
            raise ConfigError(f"unknown objective {self.objective!r}")
        if self.tile_side < 1 or self.max_iter < 1:
            raise ConfigError("tile_side and max_iter are at least 1")
        if unknown := set(self.warm_start) - set(WARM_START):
            raise ConfigError(f"unknown warm_start settings: {', '.join(sorted(unknown))}")

    @property
    def per_point_regressors(self) -> tuple[str, ...]:
        """Fields that have a value for each series and time."""
        return tuple(design.per_point(list(self.signal_terms)))

    def payload(self, geometry_hash: str | None = None) -> dict[str, Any]:
        out = {k: v for k, v in asdict(self).items() if k != "warm_start"}
        out |= {f"warm_start_{k}": v for k, v in (WARM_START | self.warm_start).items()}
        out |= {"algorithm_version": ALGORITHM_VERSION, "registry_version": REGISTRY_VERSION}
        return out | ({"geometry_hash": geometry_hash} if geometry_hash else {})

    def fit_hash(self, geometry_hash: str) -> str:
        p = self.payload(geometry_hash)
        return digest({k: p[k] for k in FIT_FIELDS})

    def compat_hash(self, geometry_hash: str) -> str:
        p = self.payload(geometry_hash)
        return digest({k: p[k] for k in COMPAT_FIELDS})

    def run_hash(self, geometry_hash: str) -> str:
        return digest(self.payload(geometry_hash))


def load(path: str) -> Config:
    """A configuration from a ``.toml`` or ``.json`` file; unknown keys are refused."""
    p = Path(path)
    try:
        text = p.read_text()
        raw = tomllib.loads(text) if p.suffix == ".toml" else json.loads(text) if p.suffix == ".json" else None
    except (OSError, ValueError) as e:
        raise ConfigError(f"{path}: {e}") from e
    if not isinstance(raw, dict):
        raise ConfigError(f"{path} is neither TOML nor JSON with a mapping")
    if unknown := set(raw) - {f.name for f in fields(Config)}:
        raise ConfigError(f"unknown settings: {', '.join(sorted(unknown))}")
    try:
        return Config(**raw)
    except TypeError as e:
        raise ConfigError(str(e)) from e
