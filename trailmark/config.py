"""Settings of the pipelines; the defaults are part of the semantics."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class CanonicalConfig:
    min_user_checkins: int = 10
    min_poi_unique_users: int = 5
    session_gap_hours: float = 6.0
    min_session_len: int = 3
    train_ratio: float = 0.70
    val_ratio: float = 0.10
    timestamp_format: str = "yyyy-MM-dd HH:mm:ss"

    def validate(self) -> CanonicalConfig:
        if min(self.min_user_checkins, self.min_poi_unique_users, self.min_session_len) < 1 or self.session_gap_hours <= 0:
            raise ValueError("thresholds must be 1 at least and the gap over 0")
        if not (0 < self.train_ratio < 1 and 0 <= self.val_ratio < 1 and self.train_ratio + self.val_ratio < 1):
            raise ValueError("train_ratio and val_ratio must leave a part for test")
        return self

    def output_name(self) -> str:
        """Folder name of a run; the split label is fixed."""
        gap = f"{self.session_gap_hours:g}".replace(".", "p")
        return f"canonical_gap{gap}h_minlen{self.min_session_len}_split701020"


@dataclass(frozen=True)
class LbsnConfig:
    min_poi_freq: int = 10
    min_user_freq: int = 10
    session_gap_minutes: int = 1440
    train_ratio: float = 0.8
    val_ratio: float = 0.1
    isolated_seconds: int = 86_400
    sequence_length: int = 50
    min_start_seq: int = 10


@dataclass(frozen=True)
class SpatialConfig:
    coarse_resolution: int = 8
    fine_resolution: int = 9
    density_radius_m: float = 100.0
    density_bins: int = 5
    connectivity_bins: int = 5
    pair_radius_m: float = 1000.0
    path_stretch: float = 2.0
    path_slack_m: float = 50.0
    distance_edges_m: tuple[int, ...] = (250, 500, 1000, 2000, 5000)
    gap_edges_min: tuple[int, ...] = (15, 30, 60, 120, 240)


@dataclass(frozen=True)
class RetrievalConfig:
    spatial: float = 3.0
    temporal: float = 1.5
    local_context: float = 1.0
    movement: float = 2.0
    prefix: float = 1.0
    category: float = 1.5
    tau_m: float = 500.0
    recent_k: int = 2
    top_k_cases: int = 20
    top_k_candidates: int = 10
    preselect_factor: int = 5
    temperature: float = 1.0

    @property
    def alpha(self) -> float:
        """Weight of the spatial kernel: its share of all block weights."""
        return self.spatial / (self.spatial + self.temporal + self.local_context + self.movement + self.prefix + self.category)


@dataclass(frozen=True)
class PrototypeConfig:
    components: tuple[int, ...] = (10, 20, 30, 50)
    covariances: tuple[str, ...] = ("diag", "full")
    max_iter: int = 300
    n_init: int = 5
    reg_covar: float = 1e-6
    tol: float = 1e-3
    top_m: int = 3
    seed: int = 42
    min_prefix_len: int = 3


@dataclass(frozen=True)
class PromptConfig:
    recent_stops: int = 4
    evidence_cases: int = 3
    max_candidates: int = 5
    top_k_return: int = 1


@dataclass(frozen=True)
class Settings:
    canonical: CanonicalConfig = field(default_factory=CanonicalConfig)
    lbsn: LbsnConfig = field(default_factory=LbsnConfig)
    spatial: SpatialConfig = field(default_factory=SpatialConfig)
    retrieval: RetrievalConfig = field(default_factory=RetrievalConfig)
    prototypes: PrototypeConfig = field(default_factory=PrototypeConfig)
    prompts: PromptConfig = field(default_factory=PromptConfig)
