import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from barloom.functions import families as f
from barloom.functions import roles as r
from barloom.functions import transforms
from barloom.functions.registry import Registry
from barloom.functions.schema import BarSchema
from barloom.functions.spec import Recurrence, ValidationMode, warmup
from barloom.operators.compute import compute, compute_lazy, since
from barloom.plans.ir import ewm, src
from barloom.plans.spark import evaluate
from tests.panels import collected, panel, schema, to_spark

OFF = ValidationMode.OFF
CLOSE = BarSchema({r.CLOSE_TR: "close", r.CLOSE_SPLIT: "close", r.CLOSE_RAW: "close"})


def run(spark, closes, *features, more=None, sch=CLOSE):
    frame = pd.DataFrame({"timestamp": pd.Timestamp("2024-01-01", tz="UTC") + pd.to_timedelta(np.arange(len(closes)), unit="D"), "symbol": "A", "close": closes, **(more or {})})
    out = collected(compute(to_spark(spark, frame), *features, schema=sch, validation=OFF))
    return [[None if v is None or v != v else v for v in out[x.spec.name].tolist()] for x in features]


@pytest.fixture(scope="module")
def everything(spark):
    """All registered features of a panel with interior gaps, in one plan."""
    found = [*Registry.default(), f.book_imbalance()]
    frame = panel(560)
    made = collected(compute(to_spark(spark, frame), *found, schema=schema(), validation=OFF))
    return found, frame, made


def test_registry_has_82_features():
    reg = Registry.default()
    assert len(reg) == 82 and "rsi_14" in reg and len({x.fingerprint for x in reg.specs()}) == 82


def test_null_until_min_history_and_then_known(everything):
    found, _, made = everything
    for x in found:
        for _, rows in made.groupby("symbol"):
            values = rows[x.spec.name]
            first = x.spec.min_history - 1
            assert values.iloc[:first].isna().all(), x.spec.name
            # some ratios stay undefined on some windows, but not on all
            if len(values) > first:
                assert values.iloc[first:].notna().any(), x.spec.name
            known = values.dropna().astype(float)
            assert np.isfinite(known).all(), x.spec.name
            if x.spec.output_range:
                low, high = x.spec.output_range
                assert known.between(low - 1e-9, high + 1e-9).all(), x.spec.name


def test_dtypes(everything):
    _, _, made = everything
    assert made["season_dow"].dtype == np.int8 and made["season_tom_3"].dtype == bool


def test_against_pandas(everything):
    _, frame, made = everything
    for symbol, rows in frame.groupby("symbol"):
        got = made[made.symbol == symbol].reset_index(drop=True)
        rows = rows.reset_index(drop=True)
        c = rows.close
        lr = np.log(c / c.shift())
        same = lambda name, want, tol=1e-9: np.testing.assert_allclose(got[name].astype(float), want, rtol=tol, atol=tol, equal_nan=True)  # noqa: B023, E731
        same("vol_cc_21", lr.rolling(21).std())
        same("skew_21", lr.rolling(21).apply(lambda x: ((x - x.mean()) ** 3).mean() / x.std(ddof=0) ** 3))
        same("kurt_21", lr.rolling(21).apply(lambda x: ((x - x.mean()) ** 4).mean() / x.std(ddof=0) ** 4 - 3))
        same("price_pctile_252", c.rolling(252).apply(lambda x: (x <= x.iloc[-1]).mean()))
        same("ols_slope_63", np.log(c).rolling(63).apply(lambda y: np.polyfit(np.arange(63), y, 1)[0]))
        same("autocorr_1_21", lr.rolling(21).corr(lr.shift()))
        same("beta_252", lr.rolling(252).cov(rows.market_ret, ddof=0) / rows.market_ret.rolling(252).var(ddof=0), 1e-8)
        ema = lambda x, span: x.ewm(span=span, adjust=False, min_periods=span).mean()
        line = ema(c, 12) - ema(c, 26)
        masked = lambda x, n: x.where(np.arange(len(x)) >= n - 1)
        same("ema_26", masked(ema(c, 26), 240))
        same("macd_signal_12_26_9", masked(line.ewm(span=9, adjust=False, min_periods=9).mean(), 323))
        change = c.diff()
        rma = lambda x: x.ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
        same("rsi_14", masked(100 - 100 / (1 + rma(change.clip(lower=0)) / rma((-change).clip(lower=0))), 249))
        pc = c.shift()
        tr = pd.concat([rows.high - rows.low, (rows.high - pc).abs(), (rows.low - pc).abs()], axis=1).max(axis=1)
        same("atr_14", masked(rma(tr), 249))
        up, down = rows.high.diff(), -rows.low.diff()
        plus = 100 * rma(up.where((up > down) & (up > 0), 0.0)) / rma(tr)
        minus = 100 * rma(down.where((down > up) & (down > 0), 0.0)) / rma(tr)
        same("adx_14", masked(rma(100 * (plus - minus).abs() / (plus + minus)), 526))
        mean = ((rows.high + rows.low + c) / 3).rolling(20)
        same("cci_20", (((rows.high + rows.low + c) / 3) - mean.mean()) / (0.015 * mean.apply(lambda x: (x - x.mean()).abs().mean())), 1e-8)


def test_cross_section_against_pandas(everything):
    _, frame, made = everything
    wide = frame.pivot(index="timestamp", columns="symbol", values="close")
    signal = np.log(wide.shift(21) / wide.shift(252))
    rank = signal.rank(axis=1).div(signal.count(axis=1), axis=0)
    got = made.pivot(index="timestamp", columns="symbol", values="xs_rank_mom_252_21")
    np.testing.assert_allclose(got.astype(float), rank, equal_nan=True)
    m, s = signal.mean(axis=1), signal.std(axis=1)
    cut = signal.clip(m - 3 * s, m + 3 * s, axis=0)
    z = cut.sub(cut.mean(axis=1), axis=0).div(cut.std(axis=1), axis=0)
    got = made.pivot(index="timestamp", columns="symbol", values="xs_z_mom_252_21")
    np.testing.assert_allclose(got.astype(float), z, equal_nan=True, atol=1e-9)


def test_causality_isolation_and_layout(spark, everything):
    """Later bars, other symbols and the layout of rows change nothing; nor does computing a feature alone."""
    found, frame, made = everything
    changed = frame.copy()
    later = changed.timestamp >= changed.timestamp.max() - pd.Timedelta(days=4)
    for c in ("open", "high", "low", "close", "volume"):
        changed.loc[later, c] *= 3.0
    twin = changed.symbol == "CCC"
    changed.loc[twin, ["open", "high", "low", "close"]] *= np.linspace(1, 2, int(twin.sum()))[:, None]
    own = [x for x in found if not x.spec.requires_universe]
    again = collected(compute(to_spark(spark, changed.sample(frac=1, random_state=1)).repartition(5), *own, schema=schema(), validation=OFF))
    keep = (made.symbol != "CCC") & (made.timestamp < made.timestamp.max() - pd.Timedelta(days=4))
    for x in own:
        a, b = made.loc[keep, x.spec.name], again.loc[keep, x.spec.name]
        np.testing.assert_allclose(a.astype(float), b.astype(float), rtol=1e-9, atol=1e-12, equal_nan=True, err_msg=x.spec.name)
    alone = collected(compute_lazy(to_spark(spark, frame), f.vol_yz(), schema=schema()))
    np.testing.assert_allclose(alone.vol_yz_21, made.vol_yz_21, equal_nan=True)


def test_recomputing_the_tail(spark, everything):
    found, frame, made = everything
    finite = [x for x in found if x.spec.recurrence is Recurrence.FINITE and not x.spec.requires_universe]
    start = frame.timestamp.max() - pd.Timedelta(days=2)
    part = since(to_spark(spark, frame), start.to_pydatetime(), finite, schema())
    assert part.count() < len(frame)
    tail = collected(compute(part, *finite, schema=schema(), validation=OFF))
    tail = tail[tail.timestamp >= start.tz_localize(None)].reset_index(drop=True)
    want = made[made.timestamp >= start.tz_localize(None)].reset_index(drop=True)
    for x in finite:
        np.testing.assert_allclose(tail[x.spec.name].astype(float), want[x.spec.name].astype(float), rtol=1e-9, atol=1e-12, equal_nan=True, err_msg=x.spec.name)


def test_interior_null_spoils_exactly_the_windows_that_hold_it(spark):
    closes = [100.0 + k % 7 for k in range(30)]
    closes[12] = None
    sma, = run(spark, closes, f.sma(5))
    assert [k for k, v in enumerate(sma) if v is None] == [0, 1, 2, 3, 12, 13, 14, 15, 16]


def test_all_null_gives_all_null(spark):
    frame = panel(40, ("A",))
    frame[[c for c in frame.columns if c not in ("timestamp", "symbol")]] = None
    small = [f.ret_log(), f.vol_yz(5), f.rsi(3), f.cmf(5), f.mfi(5), f.skew(5), f.half_life(5), f.xs_rank_mom(5, 1), f.beta(5), f.vpin(5), f.spread_corwin_schultz(), f.adx(3), f.cci(5), f.price_pctile(5), f.macd_hist(2, 3, 2)]
    made = collected(compute(to_spark(spark, frame.astype({c: object for c in frame.columns if c not in ("timestamp", "symbol")})), *small, schema=schema(), validation=OFF))
    for x in small:
        assert made[x.spec.name].isna().all(), x.spec.name


@pytest.mark.parametrize("closes", [[10.0, -5.0, 0.0, 4.0, 0.0, 0.0, 3.0, 3.0], [5.0] * 40, [1.0, -1.0] * 20])
def test_degenerate_input_is_null_never_infinite(spark, closes):
    frame = pd.DataFrame({"timestamp": pd.Timestamp("2024-01-01", tz="UTC") + pd.to_timedelta(np.arange(len(closes)), unit="D"), "symbol": "A"})
    for c in [c for c in panel(3, ("A",)).columns if c not in ("timestamp", "symbol")]:
        frame[c] = closes
    small = [f.ret_log(), f.ret_simple(), f.ret_overnight(), f.drawdown(3), f.vol_cc(3), f.vol_gk(3), f.vol_rs(3), f.vol_yz(3), f.vol_parkinson(3), f.bb_pctb(3), f.bb_bw(3), f.williams_r(3), f.stoch_d(3, 2), f.cci(3), f.vol_z(3), f.rel_volume(3), f.amihud(3), f.cmf(3), f.mfi(3), f.roll_spread(3), f.spread_corwin_schultz(), f.skew(3), f.kurt(3), f.up_down_vol_ratio(3), f.zscore_close(3), f.autocorr(1, 3), f.var_ratio(2, 4), f.half_life(3), f.beta(3), f.idio_vol(3), f.trade_imbalance(3), f.vpin(3), f.jump_rj(3), f.rskew(3), f.rkurt(3), f.quoted_spread(3), f.eff_spread(3), f.kyle_lambda(3), f.depth_imbalance(3), f.book_imbalance(2), f.xs_z_mom(2, 1)]
    made = collected(compute(to_spark(spark, frame), *small, schema=schema(), validation=OFF))
    for x in small:
        known = made[x.spec.name].dropna().astype(float)
        assert np.isfinite(known).all(), x.spec.name


def test_hand_values(spark):
    ratio, = run(spark, [100.0, 101, 99, 102, 98, 103, 97, 104], f.var_ratio(2, 5))
    assert ratio[:6] == [None] * 6 and abs(ratio[-1] - 0.1281285246242525) < 1e-12
    ramp = [float(k) for k in range(1, 26)]
    hlc = BarSchema({r.HIGH_SPLIT: "close", r.LOW_SPLIT: "close", r.CLOSE_SPLIT: "close"})
    cci, = run(spark, ramp, f.cci(20), sch=hlc)
    assert cci[18] is None and abs(cci[19] - 126.66666666666667) < 1e-9
    jump, = run(spark, [100.0] * 19 + [110.0], f.cci(20), sch=hlc)
    assert abs(jump[19] - 666.6666666666666) < 1e-9
    bw, pctb = run(spark, [5.0] * 25, f.bb_bw(), f.bb_pctb())
    assert bw[-1] == 0 and pctb[-1] is None
    up, = run(spark, [float(k) for k in range(1, 300)], f.rsi())
    assert up[247] is None and up[248] == 100.0


def test_ranks_leave_nulls_out(spark):
    rows = pd.DataFrame({"timestamp": pd.Timestamp("2024-01-01", tz="UTC"), "symbol": list("ABCDE"), "close": [1.0, 2.0, 2.0, 4.0, None]})
    made = collected(transforms.xs_rank().apply(to_spark(spark, rows), "close", CLOSE, "rank"))
    assert made["rank"].tolist()[:4] == [0.25, 0.625, 0.625, 1.0] and made["rank"].isna().tolist()[4]
    flat = collected(transforms.xs_zscore().apply(to_spark(spark, rows.assign(close=3.0)), "close", CLOSE, "z"))
    assert flat["z"].isna().all()


def test_fractional_difference(spark):
    closes = [1.0, 3.0, 6.0, 10.0, 15.0]
    frame = pd.DataFrame({"timestamp": pd.Timestamp("2024-01-01", tz="UTC") + pd.to_timedelta(np.arange(5), unit="D"), "symbol": "A", "close": closes})
    df = to_spark(spark, frame)
    take = lambda t: [None if v != v else v for v in collected(t.apply(df, "close", CLOSE, "out"))["out"].tolist()]
    assert take(transforms.frac_diff(0)) == closes
    assert take(transforms.frac_diff(1)) == [None, 2.0, 3.0, 4.0, 5.0]
    half = transforms.frac_diff(0.5, max_lag=2)
    assert np.allclose(take(half)[2:], [6 - 3 / 2 - 1 / 8, 10 - 6 / 2 - 3 / 8, 15 - 10 / 2 - 6 / 8])
    assert half.spec.fingerprint != transforms.frac_diff(0.5, max_lag=3).spec.fingerprint


@settings(max_examples=12, deadline=None)
@given(data=st.data())
def test_exponential_mean_equals_pandas(spark, data):
    alpha = data.draw(st.sampled_from([1 / 14, 2 / 13, 2 / 51, 0.06, 0.5, 0.9, 0.99]))
    seed = data.draw(st.integers(0, 1000))
    rnd = np.random.default_rng(seed)
    n = 900
    x = pd.Series(rnd.normal(100, 5, n))
    x[rnd.random(n) < data.draw(st.sampled_from([0, 0.1, 0.6]))] = np.nan
    x[:5] = np.nan
    x[300:700] = np.nan
    frame = pd.DataFrame({"timestamp": pd.Timestamp("2024-01-01", tz="UTC") + pd.to_timedelta(np.arange(n), unit="D"), "symbol": "A", "close": x})
    made = collected(evaluate(to_spark(spark, frame), {"y": ewm(src("close"), alpha, 14)}, "symbol", "timestamp"))
    want = x.ewm(alpha=alpha, adjust=False, ignore_na=False, min_periods=14).mean().where(x.notna())
    np.testing.assert_allclose(made["y"].astype(float), want, rtol=1e-10, equal_nan=True)


def test_momentum_predicts_where_drifts_differ(spark):
    rnd = np.random.default_rng(7)
    drift = np.linspace(-0.003, 0.003, 24)
    closes = 100 * np.exp(np.cumsum(rnd.normal(0, 0.01, (400, 24)) + drift, axis=0))
    rows = pd.DataFrame(closes, columns=[f"S{k:02d}" for k in range(24)]).assign(timestamp=pd.Timestamp("2020-01-01", tz="UTC") + pd.to_timedelta(np.arange(400), unit="D")).melt("timestamp", var_name="symbol", value_name="close")
    made = collected(compute(to_spark(spark, rows), f.xs_rank_mom(), schema=CLOSE, validation=OFF)).pivot(index="timestamp", columns="symbol", values="xs_rank_mom_252_21")
    ahead = np.log(pd.DataFrame(closes)).diff().shift(-1).to_numpy()
    daily = [pd.Series(a).rank().corr(pd.Series(b).rank()) for a, b in zip(made.to_numpy(), ahead) if not np.isnan(a).any() and not np.isnan(b).any()]
    assert np.mean(daily) > 0.05


def test_warmups():
    assert warmup(1 / 14) == 249 and warmup(2 / 51) == 461 and warmup(0.06) == 298
    with pytest.raises(ValueError):
        warmup(1.0)
    assert math.isclose(f.vol_ewma().spec.params["lam"], 0.94) and f.vol_ewma().spec.name == "vol_ewma_0p94"


@pytest.mark.parametrize("bad", [lambda: f.sma(1), lambda: f.sma(True), lambda: f.ret_log(0), lambda: f.mom(10, 10), lambda: f.macd(26, 12), lambda: f.bb_bw(20, 0.0), lambda: f.vol_ewma(1.0), lambda: f.var_ratio(21, 21), lambda: f.var_ratio(1, 21), lambda: f.stoch_d(14, 0), lambda: f.season_tom(0), lambda: f.book_imbalance(0), lambda: f.vpin(1), lambda: f.rsi(2.0), lambda: transforms.zscore(1), lambda: transforms.frac_diff(3.0), lambda: transforms.xs_zscore(-1.0)])
def test_bad_parameters(bad):
    with pytest.raises(ValueError):
        bad()


def test_one_exchange_for_all_time_series_features(spark):
    frame = to_spark(spark, panel(30, ("A", "B")))
    own = [x for x in Registry.default() if not x.spec.requires_universe]
    plan = compute(frame, *own, schema=schema(), validation=OFF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan
