"""Tunable rules of the risk analysis, with their defaults."""

from __future__ import annotations

import re
from dataclasses import dataclass

PERIODS = ("month", "quarter")
DROP_SCOPES = ("any", "latest")


@dataclass(frozen=True)
class RiskConfig:
    """Rules of one analysis run.

    ``drop_scope`` says which periods the single-period rule looks at: every
    observed period (``any``) or only the newest one (``latest``).
    ``grain`` adds columns, such as ``category``, to the customer key.
    Percent thresholds are in percent, margins are ratios.
    """

    period: str = "quarter"
    drop_scope: str = "any"
    grain: tuple[str, ...] = ()
    fill_empty_periods: bool = False
    prefix: str = "CUSTOMER"
    two_period_drop_pct: float = 30.0
    single_period_drop_pct: float = 50.0
    min_margin: float = 0.15
    growth_gap_points: float = 10.0
    high_drop_pct: float = 70.0
    medium_drop_pct: float = 50.0
    high_margin: float = 0.10
    medium_margin: float = 0.15

    def __post_init__(self) -> None:
        if self.period not in PERIODS:
            raise ValueError(f"period must be one of {PERIODS}, got {self.period!r}")
        if self.drop_scope not in DROP_SCOPES:
            raise ValueError(f"drop_scope must be one of {DROP_SCOPES}, got {self.drop_scope!r}")
        check_prefix(self.prefix)


def check_prefix(prefix: str) -> str:
    """Only capital letters, so that a prefix is safe inside a pattern."""
    if not re.fullmatch(r"[A-Z]+", prefix):
        raise ValueError(f"token prefix must match [A-Z]+, got {prefix!r}")
    return prefix
