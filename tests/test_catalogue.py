"""Versions, user modules, cards, lookback grids, null policies, and transforms over another column."""

import dataclasses
import sys
import types

import pandas as pd
import pytest

from barloom.functions import families as f
from barloom.functions import roles as r
from barloom.functions import transforms
from barloom.functions.registry import Registry, card, required_columns
from barloom.functions.schema import BarSchema
from barloom.functions.spec import HORIZON_LOOKBACKS, Horizon, NullKind, NullPolicy, min_valid_count
from tests.panels import collected, schema, to_spark


def version(feature, n):
    return dataclasses.replace(feature, spec=dataclasses.replace(feature.spec, version=n))


def test_the_highest_version_is_meant_by_a_name():
    held = Registry.of([version(f.rsi(), 2), f.rsi(), f.sma(50)])
    assert held.get("rsi_14").spec.version == 2 and held.get("rsi_14", 1).spec.version == 1
    assert len(held) == 3 and held.names() == ["rsi_14", "rsi_14", "sma_50"] and "rsi_14" in held
    with pytest.raises(ValueError):
        held.add(version(f.rsi(), 2))
    for wanted in (("rsi_14", 3), ("none",)):
        with pytest.raises(KeyError):
            held.get(*wanted)


def test_features_of_modules(monkeypatch):
    made = types.ModuleType("user_family")
    made.FEATURES = (f.rsi(7), f.sma(9))
    monkeypatch.setitem(sys.modules, "user_family", made)
    held = Registry.from_modules(["user_family"])
    assert held.names() == ["rsi_7", "sma_9"] and held.add(f.sma(10))


def test_columns_by_role_and_card():
    assert required_columns([f.cmf()], schema()) == {str(role): schema().column(role) for role in (r.CLOSE_SPLIT, r.HIGH_SPLIT, r.LOW_SPLIT, r.VOLUME_SPLIT)}
    with pytest.raises(KeyError):
        required_columns([f.cmf()], BarSchema({r.CLOSE_SPLIT: "close"}))
    text = card(f.cmf()).splitlines()
    assert text[0] == "cmf_21" and "min_history: 21" in text and "range: [-1.0, 1.0]" in text and text[-1].startswith("citation: Chaikin")
    assert "roles: (none)" in card(f.season_dow())


def test_lookbacks_and_null_policies():
    assert set(HORIZON_LOOKBACKS) == set(Horizon) and HORIZON_LOOKBACKS[Horizon.MICRO] == () and HORIZON_LOOKBACKS[Horizon.MEDIUM] == (21, 63, 126)
    assert min_valid_count(3).count == 3
    for bad in (lambda: NullPolicy(NullKind.MIN_VALID_COUNT), lambda: NullPolicy(NullKind.SKIP_NULLS, 2)):
        with pytest.raises(ValueError):
            bad()


def test_transforms_over_another_column(spark):
    days = pd.Timestamp("2024-01-01", tz="UTC") + pd.to_timedelta(range(6), unit="D")
    rows = pd.DataFrame({"timestamp": days, "symbol": "A", "close": [1.0, 10.0, 2.0, 30.0, 4.0, 20.0], "side": [0.0, 1.0] * 3})
    rank = collected(transforms.xs_rank().apply(to_spark(spark, rows), "close", BarSchema({r.CLOSE_RAW: "close"}), "out", over="side"))
    assert rank["out"].round(9).tolist() == [round(k / 3, 9) for k in (1, 1, 2, 3, 3, 2)]
    score = collected(transforms.zscore(3).apply(to_spark(spark, rows), "close", BarSchema({r.CLOSE_RAW: "close"}), "out", over="side"))
    want = rows.groupby("side").close.transform(lambda x: (x - x.rolling(3).mean()) / x.rolling(3).std())
    pd.testing.assert_series_equal(score["out"], want, check_names=False)
