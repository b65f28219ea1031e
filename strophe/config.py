"""Settings as dataclasses, to and from YAML; absent sections take their defaults."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields
from pathlib import Path


@dataclass
class Chunks:
    size: int = 16
    stride: int = 8
    least: int = 4


@dataclass
class Cleaning:
    least_repeats: int = 5
    least_chars: int = 100


@dataclass
class Retrieval:
    top_k: int = 5
    fetch_k: int = 30
    boost: float = 0.15
    most_overlap: float = 0.6


@dataclass
class Config:
    chunks: Chunks = field(default_factory=Chunks)
    cleaning: Cleaning = field(default_factory=Cleaning)
    retrieval: Retrieval = field(default_factory=Retrieval)

    def save(self, path: str) -> None:
        import yaml

        Path(path).write_text(yaml.safe_dump(asdict(self), sort_keys=False))

    @classmethod
    def load(cls, path: str) -> Config:
        import yaml

        given = yaml.safe_load(Path(path).read_text()) or {}
        return cls(**{f.name: f.default_factory(**given.get(f.name, {})) for f in fields(cls)})
