"""Roles: what a column means, and the adjustment basis its values are on."""

from __future__ import annotations

from dataclasses import dataclass
from enum import StrEnum


class Adjustment(StrEnum):
    TR = "tr"
    SPLIT = "split"
    RAW = "raw"


class Kind(StrEnum):
    PRICE = "price"
    VOLUME = "volume"
    QUOTE = "quote"
    DEPTH = "depth"
    FLOW = "flow"
    FACTOR = "factor"
    CALENDAR = "calendar"


FIELDS = {
    Kind.PRICE: ("open", "high", "low", "close", "vwap"),
    Kind.VOLUME: ("volume", "dollar_volume"),
    Kind.QUOTE: ("bid", "ask", "mid", "bid_size", "ask_size"),
    Kind.DEPTH: ("bid", "ask", "bid_size", "ask_size"),
    Kind.FLOW: ("signed_volume", "buy_volume", "sell_volume", "signed_dollar", "trade_count"),
    Kind.FACTOR: ("market_ret",),
    Kind.CALENDAR: ("session",),
}


@dataclass(frozen=True, order=True)
class Role:
    """``field@adjustment``; depth roles carry a level, factors and calendars no adjustment."""

    kind: Kind
    field: str
    adjustment: Adjustment | None = None
    level: int | None = None

    def __post_init__(self):
        if self.field not in FIELDS[self.kind]:
            raise ValueError(f"{self.kind} has no field {self.field!r}; it has {', '.join(FIELDS[self.kind])}")
        if (self.adjustment is None) != (self.kind in (Kind.FACTOR, Kind.CALENDAR)):
            raise ValueError(f"{self.field}: a {self.kind} role {'needs an' if self.adjustment is None else 'has no'} adjustment")
        if (self.level is not None) != (self.kind is Kind.DEPTH) or (self.level is not None and self.level < 0):
            raise ValueError(f"{self.field}: depth roles, and only they, have a level of 0 or more")

    def __str__(self) -> str:
        level = "" if self.level is None else f"_l{self.level}"
        return f"{self.field}{level}" + (f"@{self.adjustment}" if self.adjustment else "")

    @property
    def is_price(self) -> bool:
        """Whether values must be floating-point: prices, quoted prices and factors."""
        return self.kind in (Kind.PRICE, Kind.FACTOR) or (self.kind in (Kind.QUOTE, Kind.DEPTH) and not self.field.endswith("size"))


def price(field: str, adjustment: Adjustment | str) -> Role:
    return Role(Kind.PRICE, field, Adjustment(adjustment))


def volume(field: str, adjustment: Adjustment | str) -> Role:
    return Role(Kind.VOLUME, field, Adjustment(adjustment))


def quote(field: str, adjustment: Adjustment | str = Adjustment.RAW) -> Role:
    return Role(Kind.QUOTE, field, Adjustment(adjustment))


def depth(field: str, level: int, adjustment: Adjustment | str = Adjustment.RAW) -> Role:
    return Role(Kind.DEPTH, field, Adjustment(adjustment), level)


def flow(field: str, adjustment: Adjustment | str = Adjustment.RAW) -> Role:
    return Role(Kind.FLOW, field, Adjustment(adjustment))


OPEN_TR, CLOSE_TR = price("open", "tr"), price("close", "tr")
OPEN_SPLIT, HIGH_SPLIT, LOW_SPLIT, CLOSE_SPLIT, VWAP_SPLIT = (price(f, "split") for f in FIELDS[Kind.PRICE])
OPEN_RAW, HIGH_RAW, LOW_RAW, CLOSE_RAW, VWAP_RAW = (price(f, "raw") for f in FIELDS[Kind.PRICE])
VOLUME_SPLIT, VOLUME_RAW, DVOL_RAW = volume("volume", "split"), volume("volume", "raw"), volume("dollar_volume", "raw")
BID_RAW, ASK_RAW, MID_RAW, BID_SIZE_RAW, ASK_SIZE_RAW = map(quote, FIELDS[Kind.QUOTE])
SIGNED_VOLUME_RAW, BUY_VOLUME_RAW, SELL_VOLUME_RAW, SIGNED_DOLLAR_RAW, TRADE_COUNT_RAW = map(flow, FIELDS[Kind.FLOW])
MARKET_RET = Role(Kind.FACTOR, "market_ret")
SESSION = Role(Kind.CALENDAR, "session")
