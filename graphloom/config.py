"""Parameters of chunking and retrieval, with their checks."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Mapping
from dataclasses import asdict, dataclass

# The modes of retrieval and the strategies of chunking.
MODES = ("naive", "local", "global", "hybrid")
STRATEGIES = ("fixed", "sentence_window", "semantic")

# The environment variables that hold settings.
CHUNK_ENV = {
    "strategy": "CHUNKING_STRATEGY", "fixed_size": "FIXED_WINDOW_SIZE", "fixed_overlap": "FIXED_WINDOW_OVERLAP",
    "window_size": "SENTENCE_WINDOW_SIZE", "window_overlap": "SENTENCE_WINDOW_OVERLAP", "percentile": "SEMANTIC_BREAKPOINT_PERCENTILE",
    "min_sentences": "SEMANTIC_MIN_SENTENCES", "max_sentences": "SEMANTIC_MAX_SENTENCES", "buffer": "SEMANTIC_BUFFER_SIZE",
}
RETRIEVAL_ENV = {"chunks": "CHUNK_TOP_K", "entities": "ENTITY_TOP_K", "relations": "RELATION_TOP_K", "relation_candidates": "RELATION_CANDIDATE_TOP_K"}


def _from_env(kind: type, names: dict[str, str], env: Mapping[str, str] | None):
    """The settings with what the environment holds, each in the type of its default."""
    env, default = os.environ if env is None else env, kind()
    return kind(**{field: type(getattr(default, field))(env[name]) for field, name in names.items() if env.get(name)})


@dataclass(frozen=True)
class ChunkConfig:
    strategy: str = "fixed"
    fixed_size: int = 2400
    fixed_overlap: int = 200
    window_size: int = 8
    window_overlap: int = 2
    percentile: float = 90.0
    min_sentences: int = 8
    max_sentences: int = 24
    buffer: int = 1

    def __post_init__(self) -> None:
        if self.strategy.lower() not in STRATEGIES:
            raise ValueError(f"unknown chunk strategy: {self.strategy}")
        for name, size, overlap in (
            ("fixed", self.fixed_size, self.fixed_overlap),
            ("sentence window", self.window_size, self.window_overlap),
        ):
            if size <= 0:
                raise ValueError(f"{name}: the size must be positive")
            if not 0 <= overlap < size:
                raise ValueError(f"{name}: the overlap must be at least 0 and below the size")
        if not 0 <= self.percentile <= 100:
            raise ValueError("the percentile must be within 0 and 100")
        if self.min_sentences <= 0 or self.max_sentences < self.min_sentences:
            raise ValueError("the sentence limits must be positive and in order")
        if self.buffer < 0:
            raise ValueError("the buffer must not be negative")

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> ChunkConfig:
        return _from_env(cls, CHUNK_ENV, env)


@dataclass(frozen=True)
class RetrievalConfig:
    chunks: int = 5
    entities: int = 5
    relations: int = 5
    relation_candidates: int = 20

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> RetrievalConfig:
        return _from_env(cls, RETRIEVAL_ENV, env)


def fingerprint(*configs: object) -> str:
    """Identifies the settings that a store was built with."""
    text = json.dumps([asdict(c) for c in configs], sort_keys=True)  # type: ignore[call-overload]
    return hashlib.sha256(text.encode()).hexdigest()


def parse_modes(text: str) -> list[str]:
    """A comma list of modes; blanks are dropped, an unknown mode is an error, repeats stay."""
    modes = [m.strip() for m in text.split(",") if m.strip()]
    unknown = sorted(set(modes) - set(MODES))
    if unknown or not modes:
        raise ValueError(f"unknown modes: {', '.join(unknown) or 'none given'}")
    return modes
