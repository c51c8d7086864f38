"""Operator parameters, as frozen dataclasses."""

from __future__ import annotations

from dataclasses import dataclass

KEYS = ("symbol",)

# Label horizon in bars and the cap on a magnitude target in percent.
LOOKAHEAD_BARS = 20
MAX_RETURN_PCT = 5.0


@dataclass(frozen=True)
class SplitParams:
    """Chronological split; `window` is the number of bars one training sequence spans."""

    train_frac: float = 0.70
    val_frac: float = 0.15
    window: int = 60
    lookahead: int = LOOKAHEAD_BARS


@dataclass(frozen=True)
class LossParams:
    """Weights of the two-task loss."""

    direction_weight: float = 1.0
    magnitude_weight: float = 0.5
    huber_delta: float = 1.5
    max_edge: float = 3.0


@dataclass(frozen=True)
class TradeParams:
    """One trading scenario: entry thresholds, barriers, costs and account size."""

    name: str = "base"
    initial_capital: float = 100.0
    confidence: float = 0.60
    min_move: float = 0.60
    tp_fraction: float = 0.80
    sl_fraction: float = 0.50
    fee_pct: float = 0.05
    slippage_pct: float = 0.02
    position_fraction: float = 0.95
    max_hold: int = LOOKAHEAD_BARS
    ruin_equity: float = 1.0

    @property
    def round_trip_cost(self) -> float:
        return 2.0 * (self.fee_pct + self.slippage_pct) / 100.0


@dataclass(frozen=True)
class BarrierParams:
    """Take-profit / stop-loss grid in ATR multiples, with the bounds and costs applied to it."""

    lookahead: int = LOOKAHEAD_BARS
    atr_length: int = 14
    tp_multipliers: tuple[float, ...] = (1.0, 1.5, 2.0, 3.0)
    sl_multipliers: tuple[float, ...] = (0.5, 0.75, 1.0)
    fixed_tp_multiplier: float = 1.0
    fixed_sl_multiplier: float = 0.5
    min_rr: float = 1.5
    min_target_pct: float = 0.1
    max_target_pct: float = 10.0
    min_stop_pct: float = 0.05
    max_stop_pct: float = 5.0
    fee_pct: float = 0.10
    slippage_pct: float = 0.02
    max_atr_ratio: float = 2.0

    @property
    def cost_pct(self) -> float:
        return self.fee_pct + 2.0 * self.slippage_pct


@dataclass(frozen=True)
class ConfirmParams:
    """Thresholds of the confirmation filter; `enabled=False` only scores. The required flags must all speak for a
    label's side, whatever its score."""

    enabled: bool = False
    min_score: float = 8.0
    min_edge: float = 3.0
    min_return_pct: float = 0.0
    required_bull: tuple[str, ...] = ()
    required_bear: tuple[str, ...] = ()
