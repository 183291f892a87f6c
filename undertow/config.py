"""Thresholds and windows, in one place."""

from __future__ import annotations

import os
from dataclasses import dataclass


@dataclass(frozen=True)
class Defaults:
    # clustering: least cosine, look-back, neighbours looked at before entities are compared
    theta: float = 0.82
    neighbours: int = 10
    story_window_s: int = 2 * 86400
    # corroboration
    origins: int = 3
    sources: int = 2
    copy_bits: int = 6
    candidate_origins: int = 2
    # velocity
    alpha: float = 0.3
    min_buckets: int = 12
    flat_z: float = 10.0
    eps: float = 1e-9
    bin_s: int = 300
    baseline_s: int = 5 * 86400
    active_s: int = 48 * 3600
    warm_s: int = 12 * 3600
    saturation: int = 3
    alert_gap: float = 2.0
    cooldown_s: int = 6 * 3600
    # inauthenticity
    weights: tuple[float, float, float, float] = (0.30, 0.30, 0.20, 0.20)
    min_social: int = 5
    flag: float = 0.7
    rep_items: int = 3
    rep_share: float = 0.5
    sync_s: int = 60
    # primary match
    match_s: int = 24 * 3600
    match_km: float = 500.0
    match_candidates: int = 50
    # admission
    cap_per_day: int = 400_000
    halflife_s: float = 600.0
    deadband: float = 0.10
    ceiling: float = 0.99
    step: float = 0.02
    relax: float = 0.05
    slew: float = 0.05
    explore: float = 0.02
    # labels
    rows: int = 200
    per_class: int = 30
    held_out: float = 0.2
    positive: float = 0.5
    fetch: int = 5000
    # records
    retention_days: int = 5
    max_text: int = 8192
    max_entities: int = 128
    max_urls: int = 32
    max_url: int = 2048
    max_counts: int = 4096
    dateline: int = 160


D = Defaults()


@dataclass(frozen=True)
class Store:
    """Where a deployment's tables and streams are, and how long a payload may be and records stay."""

    folder: str
    replica: str = "one"
    cap: int = 65_536
    days: int = D.retention_days

    @classmethod
    def from_env(cls) -> Store:
        """UNDERTOW_FOLDER must be set; UNDERTOW_REPLICA, UNDERTOW_PAYLOAD_CAP and UNDERTOW_DAYS may be."""
        env = os.environ
        return cls(env["UNDERTOW_FOLDER"], env.get("UNDERTOW_REPLICA", cls.replica), int(env.get("UNDERTOW_PAYLOAD_CAP", cls.cap)), int(env.get("UNDERTOW_DAYS", cls.days)))
