"""Tunables of the engine, one immutable value passed to every plan."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

SECOND = 1_000_000
MINUTE, HOUR = 60 * SECOND, 3600 * SECOND


@dataclass(frozen=True)
class Config:
    """Windows are microseconds, thresholds basis points."""

    threshold_bps: float = 2.0
    threshold_mult: float = 1.0
    # Calibrated thresholds by symbol root.
    threshold_by_sym: dict[str, float] = field(default_factory=lambda: {"BTC": 3.0, "DOGE": 4.0, "ETH": 5.0, "SOL": 4.0, "XRP": 4.0})
    #: Raw symbols and their roots; empty: every symbol is its own root.
    symbols: dict[str, str] = field(default_factory=dict)
    mode: str = "tickwise"
    move_window: int = 500_000
    basis: str = "log"
    follow_window: int = 500_000
    cooldown: int = SECOND
    lag_clock: str = "event"
    dead_band: int = 100_000
    dead_band_mode: str = "fixed"
    skew_window: int = 5 * MINUTE
    skew_low: float = 0.05
    skew_high: float = 0.95
    skew_min: int = 50
    pair_mode: str = "crossVenue"
    score_window: int = MINUTE
    session_window: int = 12 * HOUR
    z: float = 1.959964
    regime_window: int = MINUTE
    tight_bps: float = 1.0
    wide_bps: float = 5.0
    low_vol_bps: float = 5.0
    stale_window: int = SECOND
    alert_cooldown: int = 300 * SECOND
    health_window: int = MINUTE
    quiet: int = 30 * SECOND
    invalid_share: float = 0.05
    invalid_min: int = 50
    fallback_share: float = 0.20
    # Notional of an imbalance bar by symbol root.
    bar_by_sym: dict[str, float] = field(default_factory=lambda: {"BTC": 300.0, "DOGE": 250.0, "ETH": 250.0, "SOL": 100.0, "XRP": 250.0})
    bar_default: float = 300.0
    trade_bps: float = 5.0
    recal_rate: float = 24.0
    recal_min_ticks: int = 5000
    recal_min_hours: float = 0.5
    recal_low: float = 0.1
    recal_high: float = 100.0

    def with_(self, **changes) -> Config:
        return replace(self, **changes)
