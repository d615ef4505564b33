"""Task configuration: a YAML file or mapping with defaults filled in."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path


@dataclass(frozen=True)
class Horizon:
    h: int
    step: int = 1
    target: str = "direct"
    probabilistic: bool = True


@dataclass(frozen=True)
class Task:
    """A forecasting task: which series, how far ahead, over which windows."""

    task: str
    series: tuple[str, ...]
    horizons: tuple[Horizon, ...]
    windows: Mapping[str, tuple[str, str]]
    primary_benchmark: str
    refit_every: int = 5
    context: int = 2048
    transform: str | None = None
    models: tuple[str, ...] = field(default=())
    estimation: str = "rolling"
    estimation_windows: Mapping[str, int] = field(default_factory=dict)

    @property
    def targets(self) -> dict[int, str]:
        return {x.h: x.target for x in self.horizons}


def load_task(source: str | Path | Mapping) -> Task:
    """``ValueError`` names what is missing."""
    if not isinstance(source, Mapping):
        import yaml

        source = yaml.safe_load(Path(source).read_text())
    missing = [k for k in ("task", "series", "horizons", "windows", "primary_benchmark") if k not in source]
    if missing:
        raise ValueError(f"the task lacks {', '.join(missing)}")
    horizons = tuple(
        Horizon(**{k: v for k, v in (x if isinstance(x, Mapping) else {"h": int(x)}).items() if k in Horizon.__dataclass_fields__}) for x in source["horizons"]
    )
    series = source["series"]
    names = [s for group in series.values() for s in group] if isinstance(series, Mapping) else list(series)
    rest = {k: source[k] for k in ("refit_every", "context", "transform", "estimation", "estimation_windows") if k in source}
    if rest.get("estimation", "rolling") not in ("rolling", "expanding"):
        raise ValueError("estimation is rolling or expanding")
    ends = {k: (str(v[0]), str(v[1])) if not isinstance(v, Mapping) else (str(v["start"]), str(v["end"])) for k, v in source["windows"].items()}
    return Task(source["task"], tuple(names), horizons, ends, source["primary_benchmark"], models=tuple(source.get("models", ())), **rest)
