import datetime as dt
import json

import pandas as pd
import pytest

from barloom.functions import families as f
from barloom.functions import roles as r
from barloom.functions.calendar import get_calendar
from barloom.functions.registry import FeatureSet, FrozenRegistryError, Manifest, Registry, cross_sectional_core, daily_core, describe, drop_warmup, max_min_history, required_columns, volatility_core
from barloom.functions.schema import BarSchema
from barloom.functions.spec import Citation, DataTier, Family, Params, Recurrence, Reference, ValidationMode, bind_feature, compose_name
from barloom.operators.bars import BAR_COLUMNS, BarKind, BarSpec, SignRule, asof_quotes, build_bars, parse_interval, sign_ticks
from barloom.operators.compute import compute, compute_lazy
from barloom.operators.validate import ValidationError, audit_frame, validate, validate_ticks
from barloom.plans.ir import log_return
from barloom.sources import panels as sources
from barloom.streaming.online import OnlineFeatures, stream_time_bars
from tests.panels import collected, panel, schema, to_spark

T0 = pd.Timestamp("2024-01-02 14:30", tz="UTC")
BARS = BarSchema.ohlcv(closed_col="closed")


def bars(spark, **changes):
    frame = panel(6, ("A", "B"))[["timestamp", "symbol", "open", "high", "low", "close", "volume"]]
    frame["closed"] = True
    for column, (row, value) in changes.items():
        frame[column] = frame[column].astype(object) if value is None else frame[column]
        frame.loc[row, column] = value
    return to_spark(spark, frame)


def test_valid_bars_pass(spark):
    assert validate(bars(spark), schema=BARS, required_roles=[r.CLOSE_TR], universe=["A", "B"]) == []


@pytest.mark.parametrize("changes, text", [({"high": (0, 1.0)}, "low must not"), ({"closed": (3, False)}, "not final"), ({"timestamp": (1, T0.replace(year=2020, month=1, day=1, hour=0, minute=0))}, "strictly increasing")])
def test_breaches_raise(spark, changes, text):
    with pytest.raises(ValidationError, match=text):
        validate(bars(spark, **changes), schema=BARS, universe=["A", "B"])


def test_research_warns_and_off_does_nothing(spark):
    frame = bars(spark, closed=(3, False))
    assert len(validate(frame, schema=BARS, universe=["A", "B", "C"], mode=ValidationMode.RESEARCH)) == 2
    with pytest.warns(UserWarning, match="not final"):
        compute(frame, f.ret_log(), schema=BARS, validation=ValidationMode.RESEARCH)
    assert validate(frame, schema=BARS, mode=ValidationMode.OFF) == []


def test_a_wrong_symbol_of_the_right_count_is_found(spark):
    with pytest.raises(ValidationError, match="universe"):
        validate(bars(spark), schema=BARS, universe=["A", "X"])


def test_types_and_roles(spark):
    frame = bars(spark)
    with pytest.raises(ValidationError, match="time zone"):
        validate(frame.selectExpr("* except(timestamp)", "cast(timestamp as timestamp_ntz) timestamp"), schema=BARS)
    with pytest.raises(ValidationError, match="float or double"):
        validate(frame.selectExpr("* except(close)", "cast(close as int) close"), schema=BARS, required_roles=[r.CLOSE_TR])
    with pytest.raises(ValidationError, match="not declared"):
        validate(frame, schema=BARS, required_roles=[r.MARKET_RET])
    with pytest.raises(ValidationError, match="missing"):
        validate(frame.drop("high"), schema=BARS)
    with pytest.raises(ValidationError, match="symbol"):
        validate(frame.drop("symbol"), schema=BARS)


def test_crossed_book(spark):
    frame = panel(3, ("A",))[["timestamp", "symbol", "bid", "ask"]]
    frame.loc[1, "bid"] = 1e6
    with pytest.raises(ValidationError, match="bid"):
        validate(to_spark(spark, frame), schema=BarSchema({r.BID_RAW: "bid", r.ASK_RAW: "ask"}))


def test_membership_end_is_exclusive(spark):
    day = lambda k: dt.datetime(2024, 1, 1 + k, tzinfo=dt.UTC)
    sch = BarSchema({r.CLOSE_TR: "close"})
    frame = spark.createDataFrame([(day(k), s, 1.0) for k in range(4) for s in "AB" if not (s == "B" and k == 3)], "timestamp timestamp, symbol string, close double")
    member = lambda end: spark.createDataFrame([("A", day(0), None), ("B", day(0), end)], "symbol string, start timestamp, end timestamp")
    assert validate(frame, schema=sch, membership=member(day(3))) == []
    with pytest.raises(ValidationError, match="lacks members"):
        validate(frame, schema=sch, membership=member(None))
    with pytest.raises(ValidationError, match="membership needs"):
        validate(frame, schema=sch, membership=frame)
    ranked = f.xs_rank_mom(2, 1)
    with pytest.raises(ValueError, match="universe"):
        compute(frame, ranked, schema=sch)
    assert compute(frame, ranked, schema=sch, membership=member(day(3))).count() == 7
    with pytest.raises(ValueError, match="cross-sectional"):
        compute_lazy(frame, ranked, schema=sch)


def test_audit(spark):
    told = audit_frame(bars(spark, high=(0, 1.0), closed=(3, False)), schema=BARS, features=[f.ret_log(), f.beta()])
    assert (told.rows, told.symbols, told.ohlc_violations, told.duplicate_keys, told.non_final_bars, told.completeness, told.timestamp_ok) == (12, 2, 1, 0, 1, 1.0, True)
    assert told.missing_roles == ("market_ret",)
    assert audit_frame(bars(spark).limit(0), schema=BARS).rows == 0
    assert audit_frame(bars(spark).drop("symbol"), schema=BARS).rows == 12


# --- ticks and bars ---------------------------------------------------------------------------


def tape(spark, prices, sizes=None, seconds=None, symbols=None, **more):
    n = len(prices)
    frame = pd.DataFrame({"timestamp": T0 + pd.to_timedelta(seconds or range(n), unit="s"), "symbol": symbols or ["A"] * n, "price": prices, "size": sizes or [4.0] * n, "seq": range(n), **more})
    return to_spark(spark, frame)


def test_volume_bars_by_hand(spark):
    made = collected(build_bars(tape(spark, [10.0, 11, 12, 20]), BarSpec(BarKind.VOLUME, threshold=10)))
    assert list(made.columns) == list(BAR_COLUMNS)
    first, second = made.to_dict("records")
    assert (first["open"], first["high"], first["low"], first["close"], first["volume"], first["trade_count"], first["vwap"], first["closed"]) == (10, 12, 10, 12, 12, 3, 11, True)
    assert first["timestamp"] == (T0 + pd.Timedelta(seconds=2)).tz_localize(None)
    assert (second["open"], second["volume"], second["closed"]) == (20, 4, False)


def test_tick_rule_and_flow(spark):
    signed = sign_ticks(tape(spark, [10.0, 11, 11, 9, 9]), BarSpec(BarKind.TICK, n_ticks=9)).orderBy("seq")
    assert [x["trade_sign"] for x in signed.collect()] == [0, 1, 1, -1, -1]
    made = collected(build_bars(tape(spark, [10.0, 11, 11, 9, 9]), BarSpec(BarKind.TICK, n_ticks=5))).iloc[0]
    assert (made.signed_volume, made.buy_volume, made.sell_volume, made.signed_dollar) == (0, 8, 8, 4 * (11 + 11 - 9 - 9))
    none = collected(build_bars(tape(spark, [10.0, 11]), BarSpec(BarKind.TICK, n_ticks=5, sign_rule=SignRule.NONE))).iloc[0]
    assert none.signed_volume == none.buy_volume == 0


def test_lee_ready(spark):
    ticks = tape(spark, [10.0, 10.0, 10.0, 10.0], bid=[9.0, 10.0, 9.0, None], ask=[10.0, 11.0, 11.0, 11.0])
    signed = sign_ticks(ticks, BarSpec(BarKind.TICK, n_ticks=2, sign_rule=SignRule.LEE_READY)).orderBy("seq")
    assert [x["trade_sign"] for x in signed.collect()] == [1, -1, 0, 0]
    with pytest.raises(ValidationError, match="quotes"):
        sign_ticks(tape(spark, [1.0]), BarSpec(BarKind.TICK, n_ticks=2, sign_rule=SignRule.LEE_READY))


def test_equal_timestamps_never_split(spark):
    made = collected(build_bars(tape(spark, [1.0, 2, 3, 4, 5], seconds=[0, 1, 1, 1, 2]), BarSpec(BarKind.TICK, n_ticks=2)))
    assert made.trade_count.tolist() == [4, 1]


def test_time_bars_are_left_closed_and_dollar_bars_may_skip(spark):
    made = collected(build_bars(tape(spark, [1.0, 2, 3], seconds=[0, 59, 60]), BarSpec(BarKind.TIME, interval="1m")))
    assert made.trade_count.tolist() == [2, 1]
    week = collected(build_bars(tape(spark, [1.0, 2, 3], seconds=[0, 5 * 86400, 6 * 86400]), BarSpec(BarKind.TIME, interval="1w")))
    assert week.trade_count.tolist() == [2, 1]  # Tuesday and Sunday, then Monday
    assert build_bars(tape(spark, [1.0, 100.0, 1.0]), BarSpec(BarKind.DOLLAR, threshold=10)).count() == 2
    assert build_bars(tape(spark, [1.0]).limit(0), BarSpec(BarKind.DOLLAR, threshold=10)).count() == 0


def test_two_symbols_do_not_mix(spark):
    made = collected(build_bars(tape(spark, [1.0, 100, 2, 200], symbols=["A", "B", "A", "B"]), BarSpec(BarKind.TICK, n_ticks=2)))
    assert made[["open", "close"]].to_numpy().tolist() == [[1, 2], [100, 200]] and not made.closed.any()


@pytest.mark.parametrize("bad", [{"kind": "time"}, {"kind": "time", "interval": "x"}, {"kind": "time", "interval": "2w"}, {"kind": "tick", "n_ticks": 0}, {"kind": "volume", "threshold": 0}, {"kind": "dollar", "threshold": 1, "n_ticks": 2}])
def test_bad_specs(bad):
    with pytest.raises(ValueError):
        BarSpec(**bad)
    assert parse_interval("15m") == (15, "minutes")


@pytest.mark.parametrize("change, text", [({"prices": [1.0, 0.0]}, "prices"), ({"prices": [1.0, 1.0], "sizes": [1.0, -1.0]}, "sizes"), ({"prices": [1.0, 1.0], "seconds": [5, 1]}, "timestamps"), ({"prices": [1.0, 1.0], "bid": [2.0, 1.0], "ask": [1.0, 2.0]}, "bid")])
def test_tick_contract(spark, change, text):
    with pytest.raises(ValidationError, match=text):
        validate_ticks(tape(spark, **change), BarSpec(BarKind.TICK, n_ticks=1))


def test_asof_quotes(spark):
    spec = BarSpec(BarKind.TICK, n_ticks=1)
    quotes = tape(spark, [0.0, 0.0], seconds=[1, 3], bid=[1.0, 3.0], ask=[2.0, 4.0])
    trades = tape(spark, [9.0, 9.0, 9.0], seconds=[0, 1, 5])
    found = [(x["bid"], x["ask"]) for x in asof_quotes(trades, quotes, spec).orderBy("seq").collect()]
    assert found == [(None, None), (1.0, 2.0), (3.0, 4.0)]


# --- catalogue --------------------------------------------------------------------------------


def test_registry(spark):
    reg = Registry.default()
    with pytest.raises(FrozenRegistryError):
        reg.add(f.sma(7))
    mine = Registry.of([f.sma(7)])
    with pytest.raises(ValueError, match="already"):
        mine.add(f.sma(7))
    expanding = bind_feature(lambda c, t: log_return(c(r.CLOSE_TR)), name="grows", family=Family.RETURNS, roles=[r.CLOSE_TR], min_history=2, citation=Citation(Reference("X", 2000)), recurrence=Recurrence.EXPANDING)
    with pytest.raises(ValueError, match="expanding"):
        mine.add(expanding)
    assert len(reg.available(DataTier.DAILY)) == 66 and len(reg.available(DataTier.MINUTE)) == 82
    assert len(reg.where(lambda s: s.family is Family.MICROSTRUCTURE)) == 16
    assert reg.frame(spark).count() == 82
    with pytest.raises(KeyError):
        reg.get("nothing")


def test_fingerprints_follow_the_formula():
    assert f.rsi().spec.fingerprint == f.rsi().spec.fingerprint
    assert f.rsi(close=r.CLOSE_RAW).spec.name == "rsi_raw_14" and f.rsi(close=r.CLOSE_RAW).spec.fingerprint != f.rsi().spec.fingerprint
    assert f.stoch_d(14, 4).spec.fingerprint != f.stoch_d(14, 3).spec.fingerprint
    with pytest.raises(ValueError):
        compose_name("Bad Name")
    with pytest.raises(ValueError, match="two features"):
        compute(None, f.rsi(), f.rsi(), schema=BARS)


def test_params():
    assert Params(a=1.0) != Params(a=1) and Params(a=-0.0) == Params(a=0.0) and len({Params(b=2, a=1), Params(a=1, b=2)}) == 1
    with pytest.raises(TypeError):
        Params(a=[1])


def test_manifest_round_trip(tmp_path):
    made = daily_core().manifest(schema())
    path = tmp_path / "m.json"
    made.to_json(path)
    assert Manifest.from_json(path) == made
    with pytest.raises(ValueError):
        Manifest.from_dict({"manifest_version": 99})
    broken = json.loads(path.read_text())
    del broken["features"]
    with pytest.raises(ValueError, match="malformed"):
        Manifest.from_dict(broken)


def test_bundles(spark):
    assert (len(daily_core()), len(volatility_core()), len(cross_sectional_core())) == (16, 4, 5)
    with pytest.raises(ValueError, match="empty"):
        FeatureSet([]).compute(None, schema=BARS)
    own = FeatureSet([f.sma(3), f.ret_log()])
    assert own.names() == ["sma_3", "ret_log_1"] and required_columns(own, BARS) == {str(r.CLOSE_TR): "close"} and max_min_history(own) == 3 and len(describe(own)) == 2
    made = own.compute(bars(spark), schema=BARS)
    assert made.columns == ["symbol", "timestamp", "sma_3", "ret_log_1"]
    assert drop_warmup(made, own, BARS).count() == 2 * (6 - 3)


def test_roles_and_schemas():
    assert str(r.CLOSE_TR) == "close@tr" and str(r.depth("bid", 2)) == "bid_l2@raw" and r.BID_RAW.is_price and not r.BID_SIZE_RAW.is_price
    for bad in (lambda: r.depth("mid", 0), lambda: r.depth("bid", -1), lambda: r.Role(r.Kind.PRICE, "close"), lambda: r.price("bid", "tr")):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(KeyError, match="declared"):
        BARS.column(r.MARKET_RET)
    assert BarSchema.quotes(bid_size="b").has(r.BID_SIZE_RAW) and BarSchema.trades().closed_col == "closed"
    assert BarSchema.ohlcv(tr_close="adj").column(r.CLOSE_TR) == "adj"
    with pytest.raises(TypeError):
        BARS.roles[r.CLOSE_TR] = "x"


def test_calendar(spark):
    days = spark.createDataFrame([(dt.datetime(2024, 1, d, tzinfo=dt.UTC),) for d in (1, 3, 4, 15, 30, 31)], "timestamp timestamp").selectExpr("timestamp", "'A' symbol")
    made = collected(compute(days, f.season_tom(), f.season_dow(), schema=BARS, validation=ValidationMode.OFF))
    assert made.season_tom_3.tolist() == [True, True, False, False, False, True] and made.season_dow.tolist() == [0, 2, 3, 0, 1, 2]
    cal = get_calendar("UTC")
    row = days.limit(1).select(cal.month_key("timestamp").alias("m"), cal.days_in_month("timestamp").alias("d"), cal.session_weekday("timestamp").alias("w"), cal.day_of_month("timestamp").alias("k")).first()
    assert tuple(row) == (2024 * 12 + 1, 31, 0, 1) and cal.bars_per_year() == 252.0
    with pytest.raises(KeyError):
        get_calendar("XNYS")


# --- sources and streams ----------------------------------------------------------------------


def test_features_are_written_and_read_by_year(spark, tmp_path):
    made = compute(bars(spark), f.ret_log(), schema=BARS)
    sources.write_features(made, str(tmp_path / "out"))
    assert sources.read_bars(spark, str(tmp_path / "out")).where("year = 2020").count() == 12


def test_online_features_equal_batch_ones(spark, tmp_path):
    frame = panel(60, ("A", "B"))
    own = [f.vol_cc(5), f.stoch_d(5, 2), f.autocorr(1, 5)]
    got = []
    online = OnlineFeatures(own, schema(), str(tmp_path / "state"), lambda df, epoch: got.append(df.toPandas()))
    for epoch, days in enumerate([(0, 20), (20, 21), (21, 60)]):
        lo, hi = (pd.Timestamp("2020-01-01", tz="UTC") + pd.Timedelta(days=d) for d in days)
        online(to_spark(spark, frame[(frame.timestamp >= lo) & (frame.timestamp < hi)]), epoch)
    streamed = pd.concat(got).sort_values(["symbol", "timestamp"]).reset_index(drop=True)
    batch = collected(compute(to_spark(spark, frame), *own, schema=schema(), validation=ValidationMode.OFF))
    pd.testing.assert_frame_equal(streamed, batch, check_exact=False, rtol=1e-9)
    with pytest.raises(ValueError, match="bounded history"):
        OnlineFeatures([f.xs_rank_mom()], schema(), "x", print)


def test_streamed_time_bars(spark, tmp_path):
    spec = BarSpec(BarKind.TIME, interval="1m")
    ticks = tape(spark, [1.0, 2, 3, 4], seconds=[0, 59, 60, 4000])
    ticks.write.parquet(str(tmp_path / "ticks"))
    stream = spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "ticks"))
    query = stream_time_bars(stream, spec, "1 minute").writeStream.format("memory").queryName("bars_out").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    made = spark.sql("select * from bars_out order by timestamp").collect()
    assert [(x["open"], x["close"], x["trade_count"]) for x in made] == [(1.0, 2.0, 2), (3.0, 3.0, 1)]


@pytest.mark.parametrize("rule", ["lee_ready", "tick_rule", "none"])
def test_dollar_bars_of_sums_on_the_threshold_equal_sql(spark, rule):
    """Running sums of cents meet the threshold again and again, where the last bit of a sum decides."""
    import random

    import duckdb

    rnd = random.Random(4)
    rows = [(rnd.choice("AB"), T0 + pd.Timedelta(seconds=k), rnd.randrange(1, 100) / 10, None if k % 97 == 5 else float(rnd.randrange(1, 4)), 5.0, 5.2, k) for k in range(6000)]
    frame = pd.DataFrame(rows, columns=["symbol", "timestamp", "price", "size", "bid", "ask", "seq"])
    frame["timestamp"] = frame["timestamp"].dt.tz_localize(None)
    con = duckdb.connect()
    con.register("ticks", frame)
    text = sources.bars_sql("dollar", 0.5, rule)
    want = con.execute(f"WITH {text} SELECT symbol, epoch_us(timestamp), trade_count, open, close FROM bars ORDER BY ALL").fetchall()
    ticks = spark.createDataFrame([(r[0], r[1].to_pydatetime(), *r[2:]) for r in rows], "symbol string, timestamp timestamp, price double, size double, bid double, ask double, seq long")
    made = build_bars(ticks, BarSpec("dollar", threshold=0.5, sign_rule=rule)).selectExpr("symbol", "unix_micros(timestamp)", "trade_count", "open", "close")
    assert sorted(map(tuple, made.collect())) == want
