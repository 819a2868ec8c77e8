"""Made-up panels, as pandas frames and Spark frames."""

import numpy as np
import pandas as pd

from barloom.functions import roles as r
from barloom.functions.schema import BarSchema

START = pd.Timestamp("2020-01-01", tz="UTC")


def series(n, seed, symbol):
    rnd = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rnd.normal(0, 0.01, n)))
    open_ = close * (1 + rnd.normal(0, 0.003, n))
    high = np.maximum(open_, close) * (1 + np.abs(rnd.normal(0, 0.004, n)))
    low = np.minimum(open_, close) * (1 - np.abs(rnd.normal(0, 0.004, n)))
    volume = rnd.integers(100_000, 1_000_000, n).astype(float)
    half = close * rnd.uniform(1e-4, 1e-3, n)
    buy = volume * rnd.uniform(0.2, 0.8, n)
    frame = pd.DataFrame({"timestamp": START + pd.to_timedelta(np.arange(n), unit="D"), "symbol": symbol, "open": open_, "high": high, "low": low, "close": close, "volume": volume})
    frame = frame.assign(vwap=(high + low + close) / 3, dollar_volume=close * volume, market_ret=np.random.default_rng(12345).normal(0, 0.01, n), bid=close - half, ask=close + half)
    frame = frame.assign(bid_size=rnd.integers(1, 5000, n).astype(float), ask_size=rnd.integers(1, 5000, n).astype(float), signed_volume=2 * buy - volume)
    for k in range(3):
        frame[f"bid_size_l{k}"] = rnd.integers(1, 5000, n).astype(float)
        frame[f"ask_size_l{k}"] = rnd.integers(1, 5000, n).astype(float)
    return frame


def panel(n=600, symbols=("AAA", "BBB", "CCC"), seed=0):
    return pd.concat([series(n, seed + k, s) for k, s in enumerate(symbols)], ignore_index=True)


def schema():
    found = {}
    for field in ("open", "high", "low", "close"):
        for basis in r.Adjustment:
            found[r.price(field, basis)] = field
    found |= {r.VWAP_SPLIT: "vwap", r.VOLUME_SPLIT: "volume", r.VOLUME_RAW: "volume", r.DVOL_RAW: "dollar_volume", r.MARKET_RET: "market_ret"}
    found |= {r.BID_RAW: "bid", r.ASK_RAW: "ask", r.BID_SIZE_RAW: "bid_size", r.ASK_SIZE_RAW: "ask_size", r.SIGNED_VOLUME_RAW: "signed_volume"}
    found |= {r.depth(side, k): f"{side}_l{k}" for side in ("bid_size", "ask_size") for k in range(3)}
    return BarSchema(found)


def to_spark(spark, frame):
    columns = [c for c in frame.columns if c not in ("timestamp", "symbol")]
    rows = [(t.to_pydatetime() if not pd.isna(t) else None, s, *(None if v is None or v != v else v for v in rest)) for t, s, *rest in frame[["timestamp", "symbol", *columns]].itertuples(index=False)]
    kinds = {"closed": "boolean", "seq": "long"}
    return spark.createDataFrame(rows, ", ".join(["timestamp timestamp", "symbol string", *(f"{c} {kinds.get(c, 'double')}" for c in columns)]))


def collected(df):
    """By symbol and time, in order."""
    return df.toPandas().sort_values(["symbol", "timestamp"]).reset_index(drop=True)
