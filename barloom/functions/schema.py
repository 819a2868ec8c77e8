"""Which column of a frame plays which role."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from types import MappingProxyType

from . import roles as r


@dataclass(frozen=True)
class BarSchema:
    roles: Mapping[r.Role, str]
    closed_col: str | None = None
    calendar: str = "UTC"
    symbol_col: str = "symbol"
    timestamp_col: str = "timestamp"

    def __post_init__(self):
        object.__setattr__(self, "roles", MappingProxyType(dict(self.roles)))

    def column(self, role: r.Role) -> str:
        if role not in self.roles:
            raise KeyError(f"role {role} is not declared; declared: {', '.join(sorted(map(str, self.roles))) or 'none'}")
        return self.roles[role]

    def has(self, role: r.Role) -> bool:
        return role in self.roles

    @classmethod
    def ohlcv(cls, *, open="open", high="high", low="low", close="close", volume="volume", tr_close=None, vwap=None, dollar_volume=None, market_ret=None, **more) -> BarSchema:
        """Daily bars: split-adjusted OHLCV, and total-return open and close."""
        found = {r.OPEN_SPLIT: open, r.HIGH_SPLIT: high, r.LOW_SPLIT: low, r.CLOSE_SPLIT: close, r.VOLUME_SPLIT: volume, r.OPEN_TR: open, r.CLOSE_TR: tr_close or close}
        found |= {k: v for k, v in ((r.VWAP_SPLIT, vwap), (r.DVOL_RAW, dollar_volume), (r.MARKET_RET, market_ret)) if v}
        return cls(found, **more)

    @classmethod
    def trades(cls, *, open="open", high="high", low="low", close="close", volume="volume", vwap=None, dollar_volume=None, signed_volume=None, buy_volume=None, sell_volume=None, signed_dollar=None, trade_count=None, closed_col="closed", **more) -> BarSchema:
        """Intraday bars of trades, on the raw basis."""
        found = {r.OPEN_RAW: open, r.HIGH_RAW: high, r.LOW_RAW: low, r.CLOSE_RAW: close, r.VOLUME_RAW: volume}
        optional = ((r.VWAP_RAW, vwap), (r.DVOL_RAW, dollar_volume), (r.SIGNED_VOLUME_RAW, signed_volume), (r.BUY_VOLUME_RAW, buy_volume), (r.SELL_VOLUME_RAW, sell_volume), (r.SIGNED_DOLLAR_RAW, signed_dollar), (r.TRADE_COUNT_RAW, trade_count))
        return cls(found | {k: v for k, v in optional if v}, closed_col=closed_col, **more)

    @classmethod
    def quotes(cls, *, bid="bid", ask="ask", bid_size=None, ask_size=None, mid=None, **more) -> BarSchema:
        """Trade bars with the best quotes."""
        base = cls.trades(**more)
        found = {r.BID_RAW: bid, r.ASK_RAW: ask} | {k: v for k, v in ((r.BID_SIZE_RAW, bid_size), (r.ASK_SIZE_RAW, ask_size), (r.MID_RAW, mid)) if v}
        return cls({**base.roles, **found}, base.closed_col, base.calendar, base.symbol_col, base.timestamp_col)
