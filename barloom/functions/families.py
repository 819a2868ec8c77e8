"""The feature factories, by family. Each returns a bound feature; formulas are nodes over the role's columns."""

from __future__ import annotations

import math

from pyspark.sql import types as T

from ..plans import ir
from ..plans.ir import absolute, across, at_least, at_most, correlation, covariance, ewm, exp, fn, lag, largest, ln, log_return, node, rank_across, rolling, sign, slope, smallest, sqrt, when, zscore_across
from . import roles as r
from . import spec as s
from .spec import Citation, Cost, DataTier, Evidence, Family, Horizon, Params, Recurrence, Reference, Unit, bind_feature, compose_name, positive, warmup
from .spec import at_least as whole

SHORT, MEDIUM, LONG = (Horizon.SHORT,), (Horizon.MEDIUM,), (Horizon.LONG,)
CONVENTION = Reference("Campbell, Lo & MacKinlay", 1997, "The Econometrics of Financial Markets")


def cite(authors: str, year: int, *empirical: tuple[str, int]) -> Citation:
    return Citation(Reference(authors, year), tuple(Reference(*e) for e in empirical))


PLAIN = Citation(CONVENTION)


def window_of(n: int, name: str = "window") -> int:
    return whole(name, n, 2)


# --- returns ----------------------------------------------------------------------------------

_RETURN = {"family": Family.RETURNS, "cost": Cost.O1, "citation": PLAIN}


def ret_log(period: int = 1, close=r.CLOSE_TR):
    whole("period", period, 1)
    return bind_feature(lambda c, t: log_return(c(close), period), name=compose_name("ret_log", period, given=[close], usual=[r.CLOSE_TR]), roles=[close], min_history=period + 1, lookback=period, unit=Unit.LOG_RETURN, params=Params(period=period), **_RETURN)


def ret_simple(period: int = 1, close=r.CLOSE_TR):
    whole("period", period, 1)
    return bind_feature(lambda c, t: c(close) / lag(c(close), period) - 1, name=compose_name("ret_simple", period, given=[close], usual=[r.CLOSE_TR]), roles=[close], min_history=period + 1, lookback=period, unit=Unit.RATIO, band=SHORT, params=Params(period=period), **_RETURN)


def ret_overnight(open_=r.OPEN_TR, close=r.CLOSE_TR):
    return bind_feature(lambda c, t: ln(c(open_) / lag(c(close))), name=compose_name("ret_overnight", given=[open_, close], usual=[r.OPEN_TR, r.CLOSE_TR]), roles=[open_, close], min_history=2, lookback=1, unit=Unit.LOG_RETURN, band=SHORT, **_RETURN)


def ret_intraday(open_=r.OPEN_TR, close=r.CLOSE_TR):
    return bind_feature(lambda c, t: ln(c(close) / c(open_)), name=compose_name("ret_intraday", given=[open_, close], usual=[r.OPEN_TR, r.CLOSE_TR]), roles=[open_, close], min_history=1, lookback=1, unit=Unit.LOG_RETURN, band=SHORT, **_RETURN)


def drawdown(window: int = 252, close=r.CLOSE_TR):
    window_of(window)
    return bind_feature(lambda c, t: c(close) / rolling("max", c(close), window) - 1, name=compose_name("drawdown", window, given=[close], usual=[r.CLOSE_TR]), roles=[close], min_history=window, lookback=window, unit=Unit.RATIO, range=(-1.0, 0.0), band=LONG, params=Params(window=window), **{**_RETURN, "cost": Cost.LINEAR})


# --- trend ------------------------------------------------------------------------------------


def _trend(formula, measure, *numbers, roles, usual, min_history, unit, citation=PLAIN, params, **more):
    more = {"band": MEDIUM, "cost": Cost.LINEAR, "evidence": Evidence.TA_CANON} | more
    return bind_feature(formula, name=compose_name(measure, *numbers, given=roles, usual=usual), roles=roles, family=Family.TREND, min_history=min_history, unit=unit, citation=citation, params=Params(**params), **more)


_RECURSIVE = {"recurrence": Recurrence.RECURSIVE_DECAY, "cost": Cost.O1}


def ema_node(x, span: int):
    return ewm(x, 2 / (span + 1), span)


def sma_dist(window: int = 50, close=r.CLOSE_TR):
    window_of(window)
    return _trend(lambda c, t: c(close) / rolling("avg", c(close), window) - 1, "sma_dist", window, roles=[close], usual=[r.CLOSE_TR], min_history=window, lookback=window, unit=Unit.RATIO, params={"window": window})


def ema_dist(span: int = 50, close=r.CLOSE_TR):
    window_of(span, "span")
    w = warmup(2 / (span + 1))
    return _trend(lambda c, t: c(close) / ema_node(c(close), span) - 1, "ema_dist", span, roles=[close], usual=[r.CLOSE_TR], min_history=w, effective_warmup=w, lookback=span, unit=Unit.RATIO, params={"span": span}, **_RECURSIVE)


def dist_52w_high(window: int = 252, close=r.CLOSE_TR):
    window_of(window)
    return _trend(lambda c, t: c(close) / rolling("max", c(close), window) - 1, "dist_52w_high", window, roles=[close], usual=[r.CLOSE_TR], min_history=window, lookback=window, unit=Unit.RATIO, range=(-1.0, 0.0), band=MEDIUM + LONG, evidence=Evidence.ACADEMIC_REPLICATED, citation=cite("George & Hwang", 2004), params={"window": window})


def price_pctile(window: int = 252, close=r.CLOSE_TR):
    window_of(window)
    formula = lambda c, t: when(ir.Node("count", (c(close),), (window,)).is_(window), ir.Node("pctile", (c(close),), (window,)))
    return _trend(formula, "price_pctile", window, roles=[close], usual=[r.CLOSE_TR], min_history=window, lookback=window, unit=Unit.RANK_0_1, range=(0.0, 1.0), band=MEDIUM + LONG, cost=Cost.HEAVY, evidence=Evidence.FORMULA_ONLY, params={"window": window})


def ols_slope(window: int = 63, close=r.CLOSE_TR):
    window_of(window)
    # the covariance with the row number over its variance, which is that of any n numbers in a row
    number = lambda y: when(y.known(), fn("mul", ir.row_number(), 1.0))
    formula = lambda c, t: covariance(number(ln(c(close))), ln(c(close)), window) / ((window**2 - 1) / 12)
    return _trend(formula, "ols_slope", window, roles=[close], usual=[r.CLOSE_TR], min_history=window, lookback=window, unit=Unit.LOG_RETURN, evidence=Evidence.FORMULA_ONLY, params={"window": window})


def _macd(which: str, fast: int, slow: int, signal: int, close):
    for name, n in (("fast", fast), ("slow", slow), ("signal", signal)):
        window_of(n, name)
    s.below("fast", fast, "slow", slow)
    w = warmup(2 / (slow + 1)) + (0 if which == "macd" else warmup(2 / (signal + 1)))

    def formula(c, t):
        line = ema_node(c(close), fast) - ema_node(c(close), slow)
        return {"macd": line, "macd_signal": ema_node(line, signal), "macd_hist": line - ema_node(line, signal)}[which]

    return _trend(formula, which, fast, slow, signal, roles=[close], usual=[r.CLOSE_TR], min_history=w, effective_warmup=w, unit=Unit.LOG_RETURN, citation=cite("Appel", 1979), params={"fast": fast, "slow": slow, "signal": signal}, **_RECURSIVE)


def macd(fast: int = 12, slow: int = 26, signal: int = 9, close=r.CLOSE_TR):
    return _macd("macd", fast, slow, signal, close)


def macd_signal(fast: int = 12, slow: int = 26, signal: int = 9, close=r.CLOSE_TR):
    return _macd("macd_signal", fast, slow, signal, close)


def macd_hist(fast: int = 12, slow: int = 26, signal: int = 9, close=r.CLOSE_TR):
    return _macd("macd_hist", fast, slow, signal, close)


def sma(window: int = 50, close=r.CLOSE_TR):
    window_of(window)
    return _trend(lambda c, t: rolling("avg", c(close), window), "sma", window, roles=[close], usual=[r.CLOSE_TR], min_history=window, lookback=window, unit=Unit.PRICE_UNITS, band=MEDIUM + LONG, params={"window": window})


def ema(span: int = 12, close=r.CLOSE_TR):
    window_of(span, "span")
    w = warmup(2 / (span + 1))
    return _trend(lambda c, t: ema_node(c(close), span), "ema", span, roles=[close], usual=[r.CLOSE_TR], min_history=w, effective_warmup=w, lookback=span, unit=Unit.PRICE_UNITS, params={"span": span}, **_RECURSIVE)


def true_range(h, low, c):
    """The first bar has no close before it: its range counts, as largest skips nulls."""
    before = lag(c)
    return largest(h - low, absolute(h - before), absolute(low - before))


def adx(window: int = 14, high=r.HIGH_SPLIT, low=r.LOW_SPLIT, close=r.CLOSE_SPLIT):
    window_of(window)
    w = 2 * warmup(1 / window) + 2 * window

    def formula(c, t):
        up, down = c(high) - lag(c(high)), lag(c(low)) - c(low)
        smooth = lambda x: ewm(x, 1 / window, window)
        tr = smooth(true_range(c(high), c(low), c(close)))
        plus = smooth(when((up > down) & (up > 0), up, 0.0)) / tr * 100
        minus = smooth(when((down > up) & (down > 0), down, 0.0)) / tr * 100
        return smooth(absolute(plus - minus) / (plus + minus) * 100)

    return _trend(formula, "adx", window, roles=[high, low, close], usual=[r.HIGH_SPLIT, r.LOW_SPLIT, r.CLOSE_SPLIT], min_history=w, effective_warmup=w, lookback=window, unit=Unit.BOUNDED_0_100, range=(0.0, 100.0), band=MEDIUM + LONG, citation=cite("Wilder", 1978), params={"window": window}, **_RECURSIVE)


# --- momentum ---------------------------------------------------------------------------------

_HLC, _HLC_USUAL = ("high", "low", "close"), [r.HIGH_SPLIT, r.LOW_SPLIT, r.CLOSE_SPLIT]


def _momentum(formula, measure, *numbers, roles, usual, min_history, unit, citation=PLAIN, params, **more):
    more = {"cost": Cost.O1, "evidence": Evidence.TA_CANON} | more
    return bind_feature(formula, name=compose_name(measure, *numbers, given=roles, usual=usual), roles=roles, family=Family.MOMENTUM, min_history=min_history, unit=unit, citation=citation, params=Params(**params), **more)


def rsi(period: int = 14, close=r.CLOSE_TR):
    window_of(period, "period")
    w = warmup(1 / period)

    def formula(c, t):
        change = c(close) - lag(c(close))
        gain, loss = (ewm(at_least(x, 0.0), 1 / period, period) for x in (change, -change))
        return when(gain.is_(0.0) & loss.is_(0.0), ir.NULL, when(loss.is_(0.0), 100.0, 100 - 100 / (1 + gain / loss)))

    return _momentum(formula, "rsi", period, roles=[close], usual=[r.CLOSE_TR], min_history=w, effective_warmup=w, lookback=period, unit=Unit.BOUNDED_0_100, range=(0.0, 100.0), citation=cite("Wilder", 1978), params={"period": period}, **_RECURSIVE)


def roc(window: int = 21, close=r.CLOSE_TR):
    whole("window", window, 1)
    return _momentum(lambda c, t: c(close) / lag(c(close), window) - 1, "roc", window, roles=[close], usual=[r.CLOSE_TR], min_history=window + 1, lookback=window, unit=Unit.RATIO, params={"window": window})


def _check_formation(formation: int, skip: int):
    whole("formation", formation, 1)
    s.below("skip", whole("skip", skip, 0), "formation", formation)


def momentum_node(c, formation: int, skip: int):
    return ln((lag(c, skip) if skip else c) / lag(c, formation))


def mom(formation: int = 252, skip: int = 21, close=r.CLOSE_TR):
    _check_formation(formation, skip)
    return _momentum(lambda c, t: momentum_node(c(close), formation, skip), "mom", formation, skip, roles=[close], usual=[r.CLOSE_TR], min_history=formation + 1, lookback=formation, unit=Unit.LOG_RETURN, band=LONG, evidence=Evidence.ACADEMIC_REPLICATED, citation=cite("Jegadeesh & Titman", 1993), params={"formation": formation, "skip": skip})


def _stochastic(c, high, low, close, window):
    top, floor = rolling("max", c(high), window), rolling("min", c(low), window)
    return top, floor, (c(close) - floor) / (top - floor) * 100


def _range_based(formula, measure, *numbers, roles, min_history, range, **more):
    return _momentum(formula, measure, *numbers, roles=roles, usual=_HLC_USUAL, min_history=min_history, unit=Unit.BOUNDED_0_100 if range[0] == 0 else Unit.UNITLESS, range=range, **{"cost": Cost.LINEAR, "citation": cite("Lane", 1984)} | more)


def williams_r(window: int = 14, high=r.HIGH_SPLIT, low=r.LOW_SPLIT, close=r.CLOSE_SPLIT):
    window_of(window)

    def formula(c, t):
        top, floor, _ = _stochastic(c, high, low, close, window)
        return (top - c(close)) / (top - floor) * -100

    return _range_based(formula, "williams_r", window, roles=[high, low, close], min_history=window, lookback=window, range=(-100.0, 0.0), citation=cite("Williams", 1979), params={"window": window})


def stoch_k(window: int = 14, high=r.HIGH_SPLIT, low=r.LOW_SPLIT, close=r.CLOSE_SPLIT):
    window_of(window)
    return _range_based(lambda c, t: _stochastic(c, high, low, close, window)[2], "stoch_k", window, roles=[high, low, close], min_history=window, lookback=window, range=(0.0, 100.0), params={"window": window})


def stoch_d(window: int = 14, smooth: int = 3, high=r.HIGH_SPLIT, low=r.LOW_SPLIT, close=r.CLOSE_SPLIT):
    window_of(window)
    whole("smooth", smooth, 1)
    return _range_based(lambda c, t: rolling("avg", _stochastic(c, high, low, close, window)[2], smooth), "stoch_d", window, smooth, roles=[high, low, close], min_history=window + smooth - 1, lookback=window, range=(0.0, 100.0), params={"window": window, "smooth": smooth})


def typical(c, high, low, close):
    return (c(high) + c(low) + c(close)) / 3.0


def cci(window: int = 20, high=r.HIGH_SPLIT, low=r.LOW_SPLIT, close=r.CLOSE_SPLIT):
    window_of(window)

    def formula(c, t):
        tp = typical(c, high, low, close)
        mean = rolling("avg", tp, window)
        spread = when(mean.known(), ir.Node("mad", (tp, mean), (window,)))
        return (tp - mean) / (spread * 0.015)

    return _momentum(formula, "cci", window, roles=[high, low, close], usual=_HLC_USUAL, min_history=window, lookback=window, unit=Unit.UNITLESS, cost=Cost.HEAVY, citation=cite("Lambert", 1980), params={"window": window})


# --- volatility -------------------------------------------------------------------------------


def _volatility(formula, measure, *numbers, roles, usual, min_history, unit=Unit.RETURN_STD_PER_BAR, citation=PLAIN, params, **more):
    more = {"cost": Cost.LINEAR, "evidence": Evidence.ACADEMIC_SINGLE} | more
    return bind_feature(formula, name=compose_name(measure, *numbers, given=roles, usual=usual), roles=roles, family=Family.VOLATILITY, min_history=min_history, unit=unit, citation=citation, params=Params(**params), **more)


def vol_cc(window: int = 21, close=r.CLOSE_TR):
    window_of(window)
    return _volatility(lambda c, t: rolling("stddev_samp", log_return(c(close)), window), "vol_cc", window, roles=[close], usual=[r.CLOSE_TR], min_history=window + 1, lookback=window, evidence=Evidence.FORMULA_ONLY, params={"window": window})


def vol_ewma(lam: float = 0.94, close=r.CLOSE_TR):
    lam = s.inside("lam", lam, 0, 1)
    w = warmup(1 - lam)

    def formula(c, t):
        ret = log_return(c(close))
        return sqrt(ewm(ret * ret, 1 - lam, 2))

    return _volatility(formula, "vol_ewma", lam, roles=[close], usual=[r.CLOSE_TR], min_history=w, effective_warmup=w, citation=cite("J.P. Morgan RiskMetrics", 1996), params={"lam": lam}, **_RECURSIVE)


def below_zero(x):
    return at_most(x, 0.0)


def semivar_down(window: int = 21, close=r.CLOSE_TR):
    window_of(window)

    def formula(c, t):
        down = below_zero(log_return(c(close)))
        return sqrt(rolling("avg", down * down, window))

    return _volatility(formula, "semivar_down", window, roles=[close], usual=[r.CLOSE_TR], min_history=window + 1, lookback=window, citation=cite("Markowitz", 1959), params={"window": window})


def _log_range(c, a, b):
    return ln(c(a) / c(b))


def vol_parkinson(window: int = 21, high=r.HIGH_SPLIT, low=r.LOW_SPLIT):
    window_of(window)

    def formula(c, t):
        hl = _log_range(c, high, low)
        return sqrt(rolling("avg", hl * hl, window) / (4 * math.log(2)))

    return _volatility(formula, "vol_parkinson", window, roles=[high, low], usual=[r.HIGH_SPLIT, r.LOW_SPLIT], min_history=window, lookback=window, citation=cite("Parkinson", 1980), params={"window": window})


_OHLC_USUAL = [r.OPEN_SPLIT, r.HIGH_SPLIT, r.LOW_SPLIT, r.CLOSE_SPLIT]


def vol_gk(window: int = 21, open_=r.OPEN_SPLIT, high=r.HIGH_SPLIT, low=r.LOW_SPLIT, close=r.CLOSE_SPLIT):
    window_of(window)

    def formula(c, t):
        hl, co = _log_range(c, high, low), _log_range(c, close, open_)
        return sqrt(rolling("avg", hl * hl * 0.5 - co * co * (2 * math.log(2) - 1), window))

    return _volatility(formula, "vol_gk", window, roles=[open_, high, low, close], usual=_OHLC_USUAL, min_history=window, lookback=window, citation=cite("Garman & Klass", 1980), params={"window": window})


def _rogers_satchell(c, open_, high, low, close):
    return _log_range(c, high, close) * _log_range(c, high, open_) + _log_range(c, low, close) * _log_range(c, low, open_)


def vol_rs(window: int = 21, open_=r.OPEN_SPLIT, high=r.HIGH_SPLIT, low=r.LOW_SPLIT, close=r.CLOSE_SPLIT):
    window_of(window)
    return _volatility(lambda c, t: sqrt(rolling("avg", _rogers_satchell(c, open_, high, low, close), window)), "vol_rs", window, roles=[open_, high, low, close], usual=_OHLC_USUAL, min_history=window, lookback=window, citation=cite("Rogers & Satchell", 1991), params={"window": window})


def vol_yz(window: int = 21, open_=r.OPEN_SPLIT, high=r.HIGH_SPLIT, low=r.LOW_SPLIT, close=r.CLOSE_SPLIT):
    window_of(window)
    k = 0.34 / (1.34 + (window + 1) / (window - 1))

    def formula(c, t):
        overnight, intraday = ln(c(open_) / lag(c(close))), _log_range(c, close, open_)
        return sqrt(rolling("var_samp", overnight, window) + rolling("var_samp", intraday, window) * k + rolling("avg", _rogers_satchell(c, open_, high, low, close), window) * (1 - k))

    return _volatility(formula, "vol_yz", window, roles=[open_, high, low, close], usual=_OHLC_USUAL, min_history=window + 1, lookback=window, citation=cite("Yang & Zhang", 2000), params={"window": window})


def atr(window: int = 14, high=r.HIGH_SPLIT, low=r.LOW_SPLIT, close=r.CLOSE_SPLIT):
    window_of(window)
    w = warmup(1 / window)
    return _volatility(lambda c, t: ewm(true_range(c(high), c(low), c(close)), 1 / window, window), "atr", window, roles=[high, low, close], usual=_HLC_USUAL, min_history=w, effective_warmup=w, lookback=window, unit=Unit.PRICE_UNITS, citation=cite("Wilder", 1978), params={"window": window}, **{**_RECURSIVE, "evidence": Evidence.TA_CANON})


def _bands(c, close, window, n_std):
    mid, width = rolling("avg", c(close), window), rolling("stddev_pop", c(close), window) * n_std
    return mid, width


def bb_pctb(window: int = 20, n_std: float = 2.0, close=r.CLOSE_SPLIT):
    window_of(window)
    n_std = positive("n_std", n_std)

    def formula(c, t):
        mid, width = _bands(c, close, window, n_std)
        return (c(close) - (mid - width)) / (width * 2)

    return _volatility(formula, "bb_pctb", window, n_std, roles=[close], usual=[r.CLOSE_SPLIT], min_history=window, lookback=window, unit=Unit.UNITLESS, evidence=Evidence.TA_CANON, citation=cite("Bollinger", 2001), params={"window": window, "n_std": n_std})


def bb_bw(window: int = 20, n_std: float = 2.0, close=r.CLOSE_SPLIT):
    window_of(window)
    n_std = positive("n_std", n_std)

    def formula(c, t):
        mid, width = _bands(c, close, window, n_std)
        return width * 2 / mid

    return _volatility(formula, "bb_bw", window, n_std, roles=[close], usual=[r.CLOSE_SPLIT], min_history=window, lookback=window, unit=Unit.RATIO, evidence=Evidence.TA_CANON, citation=cite("Bollinger", 2001), params={"window": window, "n_std": n_std})


# --- volume -----------------------------------------------------------------------------------


def _volume(formula, measure, *numbers, roles, usual, min_history, unit=Unit.UNITLESS, citation=PLAIN, params=None, **more):
    more = {"cost": Cost.LINEAR, "evidence": Evidence.FORMULA_ONLY} | more
    return bind_feature(formula, name=compose_name(measure, *numbers, given=roles, usual=usual), roles=roles, family=Family.VOLUME, min_history=min_history, unit=unit, citation=citation, params=Params(**params or {}), **more)


def vol_z(window: int = 21, volume=r.VOLUME_SPLIT):
    window_of(window)
    return _volume(lambda c, t: (c(volume) - rolling("avg", c(volume), window)) / rolling("stddev_samp", c(volume), window), "vol_z", window, roles=[volume], usual=[r.VOLUME_SPLIT], min_history=window, lookback=window, unit=Unit.ZSCORE, params={"window": window})


def rel_volume(window: int = 21, volume=r.VOLUME_SPLIT):
    window_of(window)
    return _volume(lambda c, t: c(volume) / rolling("avg", c(volume), window), "rel_volume", window, roles=[volume], usual=[r.VOLUME_SPLIT], min_history=window, lookback=window, unit=Unit.RATIO, params={"window": window})


def amihud(window: int = 21, close=r.CLOSE_TR, dollar_volume=r.DVOL_RAW):
    window_of(window)
    return _volume(lambda c, t: rolling("avg", absolute(log_return(c(close))) / c(dollar_volume), window), "amihud", window, roles=[close, dollar_volume], usual=[r.CLOSE_TR, r.DVOL_RAW], min_history=window + 1, lookback=window, evidence=Evidence.ACADEMIC_REPLICATED, citation=cite("Amihud", 2002), params={"window": window})


def vwap_dist_close(close=r.CLOSE_SPLIT, vwap=r.VWAP_SPLIT):
    return _volume(lambda c, t: c(close) / c(vwap) - 1, "vwap_dist_close", roles=[close, vwap], usual=[r.CLOSE_SPLIT, r.VWAP_SPLIT], min_history=1, lookback=1, unit=Unit.RATIO, band=SHORT, cost=Cost.O1)


_HLCV_USUAL = [*_HLC_USUAL, r.VOLUME_SPLIT]


def cmf(window: int = 21, high=r.HIGH_SPLIT, low=r.LOW_SPLIT, close=r.CLOSE_SPLIT, volume=r.VOLUME_SPLIT):
    window_of(window)

    def formula(c, t):
        spread = c(high) - c(low)
        place = when(spread.is_(0.0), 0.0, (c(close) * 2 - c(high) - c(low)) / spread)
        return rolling("sum", place * c(volume), window) / rolling("sum", c(volume), window)

    return _volume(formula, "cmf", window, roles=[high, low, close, volume], usual=_HLCV_USUAL, min_history=window, lookback=window, range=(-1.0, 1.0), evidence=Evidence.TA_CANON, citation=cite("Chaikin", 1996), params={"window": window})


def mfi(window: int = 14, high=r.HIGH_SPLIT, low=r.LOW_SPLIT, close=r.CLOSE_SPLIT, volume=r.VOLUME_SPLIT):
    window_of(window)

    def formula(c, t):
        tp = typical(c, high, low, close)
        money, change = tp * c(volume), tp - lag(tp)
        valid = change.known() & money.known()
        up = rolling("sum", when(valid, when(change > 0, money, 0.0)), window)
        down = rolling("sum", when(valid, when(change < 0, money, 0.0)), window)
        return when(up.is_(0.0) & down.is_(0.0), ir.NULL, when(down.is_(0.0), 100.0, 100 - 100 / (1 + up / down)))

    return _volume(formula, "mfi", window, roles=[high, low, close, volume], usual=_HLCV_USUAL, min_history=window + 1, lookback=window, unit=Unit.BOUNDED_0_100, range=(0.0, 100.0), evidence=Evidence.TA_CANON, citation=cite("Quong & Soudack", 1989), params={"window": window})


def roll_spread(window: int = 21, close=r.CLOSE_TR):
    window_of(window)

    def formula(c, t):
        change = c(close) - lag(c(close))
        both = covariance(change, lag(change), window)
        return when(both < 0, sqrt(-both) * 2)

    return _volume(formula, "roll_spread", window, roles=[close], usual=[r.CLOSE_TR], min_history=window + 2, lookback=window, unit=Unit.PRICE_UNITS, cost=Cost.HEAVY, evidence=Evidence.ACADEMIC_SINGLE, citation=cite("Roll", 1984), params={"window": window})


def spread_corwin_schultz(high=r.HIGH_SPLIT, low=r.LOW_SPLIT):
    def formula(c, t):
        hl = ln(c(high) / c(low))
        both = lambda pick, x: when(x.known() & lag(x).known(), pick(x, lag(x)))
        beta = hl * hl + lag(hl) * lag(hl)
        wide = ln(both(largest, c(high)) / both(smallest, c(low)))
        k = 3 - 2 * math.sqrt(2)
        alpha = (sqrt(beta * 2) - sqrt(beta)) / k - sqrt(wide * wide / k)
        return at_least((exp(alpha) - 1) * 2 / (exp(alpha) + 1), 0.0)

    return _volume(formula, "spread_corwin_schultz", roles=[high, low], usual=[r.HIGH_SPLIT, r.LOW_SPLIT], min_history=2, lookback=2, unit=Unit.RATIO, cost=Cost.HEAVY, evidence=Evidence.ACADEMIC_SINGLE, citation=cite("Corwin & Schultz", 2012))


def dollar_vol(close=r.CLOSE_SPLIT, volume=r.VOLUME_SPLIT):
    return _volume(lambda c, t: c(close) * c(volume), "dollar_vol", roles=[close, volume], usual=[r.CLOSE_SPLIT, r.VOLUME_SPLIT], min_history=1, lookback=1, band=SHORT, cost=Cost.O1)


def adv(window: int = 21, close=r.CLOSE_SPLIT, volume=r.VOLUME_SPLIT):
    window_of(window)
    return _volume(lambda c, t: rolling("avg", c(close) * c(volume), window), "adv", window, roles=[close, volume], usual=[r.CLOSE_SPLIT, r.VOLUME_SPLIT], min_history=window, lookback=window, params={"window": window})


def signed_vol(window: int = 21, close=r.CLOSE_TR, volume=r.VOLUME_SPLIT):
    window_of(window)
    return _volume(lambda c, t: rolling("sum", sign(c(close) - lag(c(close))) * c(volume), window), "signed_vol", window, roles=[close, volume], usual=[r.CLOSE_TR, r.VOLUME_SPLIT], min_history=window + 1, lookback=window, params={"window": window})


# --- distribution -----------------------------------------------------------------------------


def _distribution(formula, measure, window, close, unit=Unit.UNITLESS, **more):
    window_of(window)
    return bind_feature(lambda c, t: formula(log_return(c(close)), window), name=compose_name(measure, window, given=[close], usual=[r.CLOSE_TR]), roles=[close], family=Family.DISTRIBUTION, min_history=window + 1, lookback=window, unit=unit, params=Params(window=window), **{"citation": PLAIN} | more)


def skew(window: int = 21, close=r.CLOSE_TR):
    return _distribution(lambda x, n: rolling("skew", x, n), "skew", window, close)


def kurt(window: int = 21, close=r.CLOSE_TR):
    return _distribution(lambda x, n: rolling("kurt", x, n), "kurt", window, close)


def downside_dev(window: int = 21, close=r.CLOSE_TR):
    return _distribution(lambda x, n: sqrt(rolling("avg", below_zero(x) * below_zero(x), n)), "downside_dev", window, close, Unit.RETURN_STD_PER_BAR, evidence=Evidence.ACADEMIC_SINGLE, citation=cite("Sortino & van der Meer", 1991))


def up_down_vol_ratio(window: int = 21, close=r.CLOSE_TR):
    up = lambda x: at_least(x, 0.0)
    return _distribution(lambda x, n: sqrt(rolling("avg", up(x) * up(x), n)) / sqrt(rolling("avg", below_zero(x) * below_zero(x), n)), "up_down_vol_ratio", window, close, Unit.RATIO)


# --- mean reversion ---------------------------------------------------------------------------


def _reversion(formula, measure, *numbers, close, min_history, lookback, params, unit=Unit.UNITLESS, **more):
    return bind_feature(lambda c, t: formula(c(close)), name=compose_name(measure, *numbers, given=[close], usual=[r.CLOSE_TR]), roles=[close], family=Family.MEAN_REVERSION, min_history=min_history, lookback=lookback, unit=unit, params=Params(**params), **{"citation": PLAIN} | more)


def zscore_close(window: int = 21, close=r.CLOSE_TR):
    window_of(window)
    return _reversion(lambda c: (c - rolling("avg", c, window)) / rolling("stddev_samp", c, window), "zscore_close", window, close=close, min_history=window, lookback=window, params={"window": window}, unit=Unit.ZSCORE)


def autocorr(lag: int = 1, window: int = 21, close=r.CLOSE_TR):
    whole("lag", lag, 1)
    window_of(window)
    return _reversion(lambda c: correlation(log_return(c), ir.lag(log_return(c), lag), window), "autocorr", lag, window, close=close, min_history=window + lag + 1, lookback=window, params={"lag": lag, "window": window})


def var_ratio(q: int = 2, window: int = 21, close=r.CLOSE_TR):
    window_of(q, "q")
    s.below("q", q, "window", window_of(window))
    rows = window - q + 1

    def formula(c):
        # about the window's mean m: the sum of (x - q m)**2 is that about x's own mean and a shift
        one, many = log_return(c), log_return(c, q)
        m = rolling("avg", one, window)
        shift = rolling("avg", many, rows) - m * q
        spread = rolling("var_pop", many, rows) * rows + shift * shift * rows
        long_run = spread / (q * rows * (1 - q / window))
        return ir.after(long_run / rolling("var_samp", one, window), window + q)

    return _reversion(formula, "var_ratio", q, window, close=close, min_history=window + q, lookback=window, params={"q": q, "window": window}, cost=Cost.HEAVY, evidence=Evidence.ACADEMIC_REPLICATED, citation=cite("Lo & MacKinlay", 1988), unit=Unit.RATIO)


def half_life(window: int = 60, close=r.CLOSE_TR):
    window_of(window)

    def formula(c):
        beta = slope(when((c - lag(c)).known(), lag(c)), c - lag(c), window)
        return when((beta > -1) & (beta < 0), node(-math.log(2)) / ln(1 + beta))

    return _reversion(formula, "half_life", window, close=close, min_history=window + 1, lookback=window, params={"window": window}, band=MEDIUM, evidence=Evidence.ACADEMIC_SINGLE, citation=cite("Ornstein & Uhlenbeck", 1930))


# --- seasonality ------------------------------------------------------------------------------


def season_dow():
    return bind_feature(lambda c, t: fn("weekday", t), name="season_dow", family=Family.SEASONALITY, roles=[], min_history=1, lookback=1, dtype=T.ByteType(), band=SHORT, cost=Cost.O1, evidence=Evidence.ACADEMIC_SINGLE, citation=cite("French", 1980))


def season_tom(k: int = 3):
    whole("k", k, 1)
    formula = lambda c, t: (fn("dayofmonth", t) <= k) | fn("dayofmonth", t).is_(fn("monthdays", t))
    return bind_feature(formula, name=compose_name("season_tom", k), family=Family.SEASONALITY, roles=[], min_history=1, lookback=1, dtype=T.BooleanType(), cost=Cost.O1, evidence=Evidence.ACADEMIC_SINGLE, citation=cite("Ariel", 1987), params=Params(k=k))


# --- cross-sectional --------------------------------------------------------------------------


def _cross(formula, measure, *numbers, roles, usual, min_history, lookback, unit, citation, params, **more):
    return bind_feature(formula, name=compose_name(measure, *numbers, given=roles, usual=usual), roles=roles, family=Family.CROSS_SECTIONAL, min_history=min_history, lookback=lookback, unit=unit, citation=citation, params=Params(**params), band=LONG, evidence=Evidence.ACADEMIC_REPLICATED, **more)


def xs_rank_mom(formation: int = 252, skip: int = 21, close=r.CLOSE_TR):
    _check_formation(formation, skip)
    return _cross(lambda c, t: rank_across(momentum_node(c(close), formation, skip)), "xs_rank_mom", formation, skip, roles=[close], usual=[r.CLOSE_TR], min_history=formation + 1, lookback=formation, unit=Unit.RANK_0_1, range=(0.0, 1.0), citation=cite("Jegadeesh & Titman", 1993), params={"formation": formation, "skip": skip}, requires_universe=True)


def xs_z_mom(formation: int = 252, skip: int = 21, close=r.CLOSE_TR):
    _check_formation(formation, skip)
    return _cross(lambda c, t: zscore_across(momentum_node(c(close), formation, skip), 3.0), "xs_z_mom", formation, skip, roles=[close], usual=[r.CLOSE_TR], min_history=formation + 1, lookback=formation, unit=Unit.ZSCORE, citation=cite("Jegadeesh & Titman", 1993), params={"formation": formation, "skip": skip}, requires_universe=True)


def rev_1m(window: int = 21, close=r.CLOSE_TR):
    whole("window", window, 1)
    return _cross(lambda c, t: rank_across(-log_return(c(close), window)), "rev_1m", window, roles=[close], usual=[r.CLOSE_TR], min_history=window + 1, lookback=window, unit=Unit.RANK_0_1, range=(0.0, 1.0), citation=cite("Jegadeesh", 1990), params={"window": window}, requires_universe=True)


def beta(window: int = 252, close=r.CLOSE_TR, market=r.MARKET_RET):
    window_of(window)
    return _cross(lambda c, t: slope(c(market), log_return(c(close)), window), "beta", window, roles=[close, market], usual=[r.CLOSE_TR, r.MARKET_RET], min_history=window + 1, lookback=window, unit=Unit.UNITLESS, citation=cite("Sharpe", 1964), params={"window": window})


def idio_vol(window: int = 252, close=r.CLOSE_TR, market=r.MARKET_RET):
    window_of(window)

    def formula(c, t):
        ret, m = log_return(c(close)), c(market)
        both = covariance(ret, m, window)
        return sqrt(covariance(ret, ret, window) - both * both / covariance(m, m, window))

    return _cross(formula, "idio_vol", window, roles=[close, market], usual=[r.CLOSE_TR, r.MARKET_RET], min_history=window + 1, lookback=window, unit=Unit.RETURN_STD_PER_BAR, citation=cite("Ang, Hodrick, Xing & Zhang", 2006), params={"window": window})


# --- microstructure ---------------------------------------------------------------------------


def _micro(formula, measure, *numbers, roles, usual, min_history, params, citation, lookback=None, **more):
    more = {"evidence": Evidence.ACADEMIC_SINGLE} | more
    return bind_feature(formula, name=compose_name(measure, *numbers, given=roles, usual=usual), roles=roles, family=Family.MICROSTRUCTURE, min_history=min_history, lookback=lookback or min_history, citation=citation, params=Params(**params), band=(Horizon.MICRO, Horizon.INTRADAY), tier=DataTier.MINUTE, **more)


_FLOW_USUAL = [r.SIGNED_VOLUME_RAW, r.VOLUME_RAW]


def trade_imbalance(window: int = 12, signed=r.SIGNED_VOLUME_RAW, volume=r.VOLUME_RAW):
    window_of(window)
    return _micro(lambda c, t: rolling("sum", c(signed), window) / rolling("sum", c(volume), window), "trade_imbalance", window, roles=[signed, volume], usual=_FLOW_USUAL, min_history=window, params={"window": window}, range=(-1.0, 1.0), evidence=Evidence.ACADEMIC_REPLICATED, citation=cite("Chordia & Subrahmanyam", 2004))


def vpin(n_buckets: int = 50, signed=r.SIGNED_VOLUME_RAW, volume=r.VOLUME_RAW):
    window_of(n_buckets, "n_buckets")
    return _micro(lambda c, t: rolling("avg", absolute(c(signed)) / c(volume), n_buckets), "vpin", n_buckets, roles=[signed, volume], usual=_FLOW_USUAL, min_history=n_buckets, params={"n_buckets": n_buckets}, range=(0.0, 1.0), evidence=Evidence.ACADEMIC_REPLICATED, citation=cite("Easley, Lopez de Prado & O'Hara", 2012))


def sign_autocorr(lag: int = 1, window: int = 78, signed=r.SIGNED_VOLUME_RAW, volume=r.VOLUME_RAW):
    whole("lag", lag, 1)
    window_of(window)

    def formula(c, t):
        share = c(signed) / c(volume)
        return correlation(share, ir.lag(share, lag), window)

    return _micro(formula, "sign_autocorr", lag, window, roles=[signed, volume], usual=_FLOW_USUAL, min_history=window + lag, lookback=window, params={"lag": lag, "window": window}, range=(-1.0, 1.0), evidence=Evidence.ACADEMIC_REPLICATED, citation=cite("Hasbrouck & Ho", 1987))


def realized_variance(ret, n: int):
    return rolling("sum", ret * ret, n)


def bipower_variation(ret, n: int):
    return rolling("sum", absolute(ret) * absolute(lag(ret)), n - 1) * (math.pi / 2)


def _from_returns(measure: str, window: int, close, formula, citation, **more):
    window_of(window)
    return _micro(lambda c, t: formula(log_return(c(close)), window), measure, window, roles=[close], usual=[r.CLOSE_RAW], min_history=window + 1, params={"window": window}, citation=citation, **more)


def rvar(window: int = 78, close=r.CLOSE_RAW):
    return _from_returns("rvar", window, close, realized_variance, cite("Andersen & Bollerslev", 1998))


def bipower(window: int = 78, close=r.CLOSE_RAW):
    return _from_returns("bipower", window, close, bipower_variation, cite("Barndorff-Nielsen & Shephard", 2004))


def jump_rj(window: int = 78, close=r.CLOSE_RAW):
    return _from_returns("jump_rj", window, close, lambda x, n: at_least(realized_variance(x, n) - bipower_variation(x, n), 0.0) / realized_variance(x, n), cite("Huang & Tauchen", 2005), range=(0.0, 1.0))


def rsemivar_up(window: int = 78, close=r.CLOSE_RAW):
    return _from_returns("rsemivar_up", window, close, lambda x, n: realized_variance(at_least(x, 0.0), n), cite("Barndorff-Nielsen, Kinnebrock & Shephard", 2010))


def rsemivar_dn(window: int = 78, close=r.CLOSE_RAW):
    return _from_returns("rsemivar_dn", window, close, lambda x, n: realized_variance(at_most(x, 0.0), n), cite("Barndorff-Nielsen, Kinnebrock & Shephard", 2010))


def signed_jump(window: int = 78, close=r.CLOSE_RAW):
    return _from_returns("signed_jump", window, close, lambda x, n: rolling("sum", x * absolute(x), n), cite("Patton & Sheppard", 2015))


def rskew(window: int = 78, close=r.CLOSE_RAW):
    return _from_returns("rskew", window, close, lambda x, n: rolling("sum", x * x * x, n) * math.sqrt(n) / (realized_variance(x, n) * sqrt(realized_variance(x, n))), cite("Amaya, Christoffersen, Jacobs & Vasquez", 2015))


def rkurt(window: int = 78, close=r.CLOSE_RAW):
    return _from_returns("rkurt", window, close, lambda x, n: rolling("sum", x * x * x * x, n) * n / (realized_variance(x, n) * realized_variance(x, n)), cite("Amaya, Christoffersen, Jacobs & Vasquez", 2015))


_QUOTE_USUAL = [r.BID_RAW, r.ASK_RAW]


def _mid(c, bid, ask):
    """Null where the book is crossed."""
    return when(c(bid) <= c(ask), (c(bid) + c(ask)) / 2.0)


def quoted_spread(window: int = 78, bid=r.BID_RAW, ask=r.ASK_RAW):
    window_of(window)
    return _micro(lambda c, t: rolling("avg", (c(ask) - c(bid)) / _mid(c, bid, ask), window), "quoted_spread", window, roles=[bid, ask], usual=_QUOTE_USUAL, min_history=window, params={"window": window}, unit=Unit.RATIO, citation=cite("Demsetz", 1968))


def eff_spread(window: int = 78, close=r.CLOSE_RAW, bid=r.BID_RAW, ask=r.ASK_RAW):
    window_of(window)
    return _micro(lambda c, t: rolling("avg", absolute(c(close) - _mid(c, bid, ask)) * 2 / _mid(c, bid, ask), window), "eff_spread", window, roles=[close, bid, ask], usual=[r.CLOSE_RAW, *_QUOTE_USUAL], min_history=window, params={"window": window}, unit=Unit.RATIO, citation=cite("Huang & Stoll", 1996))


def amihud_intraday(window: int = 78, close=r.CLOSE_RAW, volume=r.VOLUME_RAW):
    window_of(window)
    return _micro(lambda c, t: rolling("avg", absolute(log_return(c(close))) / (c(close) * c(volume)), window), "amihud_intraday", window, roles=[close, volume], usual=[r.CLOSE_RAW, r.VOLUME_RAW], min_history=window + 1, params={"window": window}, citation=cite("Amihud", 2002))


def kyle_lambda(window: int = 78, close=r.CLOSE_RAW, signed=r.SIGNED_VOLUME_RAW):
    window_of(window)
    return _micro(lambda c, t: slope(c(signed), c(close) - lag(c(close)), window), "kyle_lambda", window, roles=[close, signed], usual=[r.CLOSE_RAW, r.SIGNED_VOLUME_RAW], min_history=window + 1, params={"window": window}, citation=cite("Kyle", 1985))


def depth_imbalance(window: int = 78, bid_size=r.BID_SIZE_RAW, ask_size=r.ASK_SIZE_RAW):
    window_of(window)
    return _micro(lambda c, t: rolling("avg", (c(bid_size) - c(ask_size)) / (c(bid_size) + c(ask_size)), window), "depth_imbalance", window, roles=[bid_size, ask_size], usual=[r.BID_SIZE_RAW, r.ASK_SIZE_RAW], min_history=window, params={"window": window}, range=(-1.0, 1.0), citation=cite("Cao, Hansch & Wang", 2009))


def book_imbalance(levels: int = 3):
    whole("levels", levels, 1)
    bids, asks = ([r.depth(side, k) for k in range(levels)] for side in ("bid_size", "ask_size"))

    def formula(c, t):
        bid, ask = (sum((c(x) for x in side[1:]), start=c(side[0])) for side in (bids, asks))
        return (bid - ask) / (bid + ask)

    return _micro(formula, "book_imbalance", levels, roles=[*bids, *asks], usual=[*bids, *asks], min_history=1, params={"levels": levels}, range=(-1.0, 1.0), citation=cite("Cao, Hansch & Wang", 2009))


def default_features() -> list[s.BoundFeature]:
    """The registered features, by family."""
    return [
        ret_log(1), ret_log(5), ret_log(21), ret_log(252), ret_simple(), ret_overnight(), ret_intraday(), drawdown(),
        vol_cc(21), vol_cc(63), vol_ewma(), semivar_down(), vol_parkinson(), vol_gk(), vol_rs(), vol_yz(), atr(), bb_pctb(), bb_bw(),
        rsi(), roc(21), roc(10), mom(), williams_r(), stoch_k(), stoch_d(), cci(),
        sma_dist(), ema_dist(), dist_52w_high(), price_pctile(), ols_slope(), macd(), macd_signal(), macd_hist(), sma(50), sma(200), ema(12), ema(26), adx(),
        vol_z(), rel_volume(), amihud(), vwap_dist_close(), cmf(), mfi(), roll_spread(), spread_corwin_schultz(), dollar_vol(), adv(), signed_vol(),
        skew(), kurt(), downside_dev(), up_down_vol_ratio(),
        zscore_close(), autocorr(), var_ratio(), half_life(),
        season_dow(), season_tom(),
        xs_rank_mom(), xs_z_mom(), rev_1m(), beta(), idio_vol(),
        trade_imbalance(), vpin(), sign_autocorr(), rvar(), bipower(), jump_rj(), rsemivar_up(), rsemivar_dn(), signed_jump(), rskew(), rkurt(), quoted_spread(), eff_spread(), amihud_intraday(), kyle_lambda(), depth_imbalance(),
    ]
