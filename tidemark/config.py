"""Settings with their defaults; values out of range are moved into it."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from .functions.score import DAY

#: Least and most of the numeric settings.
RANGES = {
    "max_entry_chars": (10, 10_000), "default_recall_tokens": (100, 100_000), "default_recall_limit": (1, 100), "graph_max_entities": (10, 100_000),
    "infer_max_hops": (1, 3), "distill_min_cluster": (2, 20), "recall_threshold": (0.0, 1.0),
}
CHOICES = {"capture_mode": ("off", "conservative", "balanced", "aggressive"), "fusion_mode": ("interpolate", "rrf"), "supersede_mode": ("off", "auto"), "conflict_mode": ("off", "auto"), "distill_mode": ("off", "auto"), "consolidation_mode": ("off", "auto")}


@dataclass(frozen=True)
class Config:
    max_entry_chars: int = 1000
    default_recall_tokens: int = 800
    default_recall_limit: int = 8
    capture_mode: str = "balanced"
    auto_tags: bool = True
    dedup_window_ms: int = DAY
    ttl_days: float = 0
    recall_decay_days: float = 0
    import_sources: tuple = ()
    supersede_mode: str = "off"
    semantic_boost: bool = False
    fusion_mode: str = "interpolate"
    max_entries: int = 0
    auto_evict: bool = False
    themes: bool = False
    distill_mode: str = "off"
    consolidation_mode: str = "off"
    graph_enabled: bool = False
    conflict_mode: str = "off"
    conflict_window_ms: int = 30 * DAY
    graph_max_entities: int = 2000
    infer_enabled: bool = False
    infer_max_hops: int = 2
    distill_min_cluster: int = 3
    recall_threshold: float = 0.4
    passphrase: str = ""
    vector_enabled: bool = False
    storage_dir: str = ""

    def clamped(self) -> Config:
        out = {k: min(hi, max(lo, getattr(self, k))) for k, (lo, hi) in RANGES.items()}
        defaults = {f.name: f.default for f in fields(self)}
        out |= {k: defaults[k] for k, allowed in CHOICES.items() if getattr(self, k) not in allowed}
        return replace(self, **out)
