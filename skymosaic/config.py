"""Settings of a run: plain data classes, read from JSON or from any mapping."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, fields


@dataclass(frozen=True)
class Data:
    images: str = "images"
    labels: str = "labels"
    output: str = "output"


@dataclass(frozen=True)
class Tiling:
    size: int = 768
    overlap: int = 384
    least_visible: float = 0.25


@dataclass(frozen=True)
class Model:
    prompts: tuple[str, ...] = ()
    confidence: float = 0.25


@dataclass(frozen=True)
class Evaluation:
    iou: float = 0.5
    forced_crs: int | None = None


@dataclass(frozen=True)
class Config:
    data: Data = field(default_factory=Data)
    tiling: Tiling = field(default_factory=Tiling)
    model: Model = field(default_factory=Model)
    evaluation: Evaluation = field(default_factory=Evaluation)

    @staticmethod
    def of(values: Mapping[str, Mapping]) -> Config:
        """From sections of settings; unknown sections and settings raise ValueError."""
        kinds = {f.name: f.default_factory for f in fields(Config)}
        made = {}
        for section, settings in values.items():
            if section not in kinds:
                raise ValueError(f"unknown section {section}")
            unknown = set(settings) - {f.name for f in fields(kinds[section])}
            if unknown:
                raise ValueError(f"unknown setting {section}.{sorted(unknown)[0]}")
            made[section] = kinds[section](**{k: tuple(v) if isinstance(v, list) else v for k, v in settings.items()})
        return Config(**made)

    @staticmethod
    def read(path: str) -> Config:
        with open(path) as f:
            return Config.of(json.load(f))

    def write(self, path: str) -> None:
        with open(path, "w") as f:
            json.dump(asdict(self), f, indent=2)
