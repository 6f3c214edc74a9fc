"""Every tunable of the library in one place."""

from __future__ import annotations

from dataclasses import dataclass

MINUTE = 60_000
HOUR = 60 * MINUTE
DAY = 24 * HOUR


@dataclass(frozen=True)
class Params:
    # The defaults define the semantics users of the operators rely on.
    # -- time grid
    fine_ms: int = 15 * MINUTE
    coarse_ms: int = 4 * HOUR
    bars_per_coarse: int = 16
    bars_per_day: int = 96
    rate_ms: int = 8 * HOUR
    # -- indicators (in completed coarse bars)
    channel_entry: int = 60
    channel_exit: int = 20
    atr_n: int = 28
    return_lags: tuple = (1, 5, 20, 60)
    vol_short: int = 20
    vol_long: int = 60
    run_clip: int = 10
    # -- regime
    sma_fast: int = 60
    sma_slow: int = 180
    vol_history: int = 1080
    vol_quantile: float = 0.90
    # -- outcome rules
    stop_mult: float = 2.0
    target_mult: float = 3.0
    max_hold: int = 42
    # -- universe
    min_history_ms: int = 90 * DAY
    min_liquidity: float = 25_000_000.0
    trailing_days: int = 30
    min_defined_days: int = 20
    min_completeness: float = 0.99
    top_n: int = 75
    daily_min_bars: int = 90
    tradable_ms: int = 2 * DAY
    # -- costs
    fee: float = 0.0005
    tier1_top: int = 10
    half_spread: tuple = (0.0001, 0.00025)
    slippage: tuple = (0.00015, 0.00035)
    stop_slip_mult: float = 2.0
    # -- validity, span, partition
    min_eligible: int = 30
    span_window_ms: int = 60 * DAY
    span_fraction: float = 0.95
    span_buffer_ms: int = 48 * HOUR
    train_fraction: float = 0.60
    validation_fraction: float = 0.80
    # -- risk limits (fractions of equity)
    max_risk: float = 0.010
    max_gross: float = 1.50
    max_directional: float = 1.20
    max_positions: int = 10
    daily_loss: float = 0.03
    drawdown_limit: float = 0.25
    drawdown_days: int = 90
    min_notional: float = 50.0
    # -- resampling
    block_ms: int = 28 * DAY
    periods_per_year: float = 365.25 * 6
    support_num: int = 50
    support_den: int = 750
    alpha: float = 0.05

    @property
    def atr_min_bars(self) -> int:
        return 3 * self.atr_n

    @property
    def max_horizon_ms(self) -> int:
        return self.max_hold * self.coarse_ms + self.fine_ms


DEFAULTS = Params()
