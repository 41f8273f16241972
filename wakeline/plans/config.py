"""Settings of the pipeline's stages, with the defaults a run starts from: fixed values."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class PrepConfig:
    min_rating: float = 0.5
    min_items: int = 10
    max_items: int = 5000
    negatives: int = 19
    seed: int = 42


@dataclass(frozen=True)
class WindowConfig:
    size: int = 3
    last: int = 30
    history: int = 10


@dataclass(frozen=True)
class TreeConfig:
    clusters: int = 50
    restarts: int = 20
    rounds: int = 300
    min_similarity: float = 0.55
    min_margin: float = 0.02
    keep_ambiguous: bool = False
    cluster_text: str = "structured_combined"
    bucket: tuple[str, ...] = ("mechanism",)  # or mechanism, scope; or all three
    max_order: int = 5
    count_mode: str = "user_normalized"
    kappa: float = 5.0
    min_users: int = 3
    min_occurrences: int = 3
    min_jsd: float = 0.05
    promote_order1: bool = True
    collapse: bool = False
    top_next: int = 5
    seed: int = 42

    def __post_init__(self):
        if self.bucket not in (("mechanism",), ("mechanism", "scope"), ("mechanism", "scope", "direction")):
            raise ValueError(f"unknown constraint level {self.bucket}")


@dataclass(frozen=True)
class EvalConfig:
    candidates: int = 20
    ks: tuple[int, ...] = (1, 3, 5, 10, 15, 20)
    modes: tuple[str, ...] = field(default=("tree", "latest_only", "native"))
    seed: int = 42
