"""Business parameters. Labels have no default; shapes of models and bands have the usual ones."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

PRODUCTS = ("new", "semi", "used")
TOTAL = "total"


@dataclass(frozen=True)
class StockLabels:
    """The values a stock snapshot uses for statuses, descriptions and product classes."""

    # status types
    rented: str
    ready: str
    sale: str
    unavailable: str
    total_loss: str
    stolen: str
    administrative: str
    factory_new: str
    transit_new: str
    # status descriptions
    in_maintenance: str
    in_transit_new: str
    received_new: str
    own_programme: tuple[str, ...]
    awaiting_auction: str
    between_branches: str
    collected: str
    impounded: str
    misappropriated: str
    # operational flag and product classes, in the order of PRODUCTS
    operational: str
    classes: tuple[str, str, str] = PRODUCTS


@dataclass(frozen=True)
class SegmentRules:
    """How branches are banded by population and folded into consolidated regions."""

    buckets: int = 5
    # one letter per bucket, smallest population first
    letters: tuple[str, ...] = ("D", "C", "B", "A", "S")
    # tier by lowest bucket it covers, highest first; the last name takes the rest
    tiers: tuple[tuple[int, str], ...] = ((5, "megacity"), (4, "metropolis"), (3, "regional centre"))
    lowest_tier: str = "interior"
    # country -> consolidated label, wins over the city rules
    country_overrides: dict[str, str] = field(default_factory=dict)
    # (region, city) -> consolidated label
    capital_overrides: dict[tuple[str, str], str] = field(default_factory=dict)


@dataclass(frozen=True)
class BoostedConfig:
    """Shape of the global tree model and of its holdout."""

    target_lags: int = 12
    covariate_lags: int = 6
    window_months: int = 24
    holdout_months: int = 4
    horizon: int = 12
    trees: int = 800
    learning_rate: float = 0.05
    max_depth: int = 5
    # split points looked at per feature, and the fewest rows of a leaf
    max_bins: int = 255
    min_leaf: int = 20
    seed: int = 42


@dataclass(frozen=True)
class EnsembleConfig:
    cutoff: date
    horizon: int = 7
    window: int = 3
    alpha: float = 0.3
