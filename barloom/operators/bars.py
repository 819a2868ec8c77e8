"""Ticks to bars: time, tick, volume and dollar bars with trade signing."""

from __future__ import annotations

from dataclasses import dataclass
from enum import StrEnum

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.spec import ValidationMode, at_least, positive
from .validate import ValidationError, validate_ticks


class BarKind(StrEnum):
    TIME = "time"
    TICK = "tick"
    VOLUME = "volume"
    DOLLAR = "dollar"


class SignRule(StrEnum):
    NONE = "none"
    TICK_RULE = "tick_rule"
    LEE_READY = "lee_ready"


#: Interval suffixes and the units they stand for.
UNITS = {"us": "microseconds", "ms": "milliseconds", "s": "seconds", "m": "minutes", "h": "hours", "d": "days", "w": "week", "mo": "month"}
#: Levels of the tree by which running sums are added.
LEVELS = 6
BAR_COLUMNS = ("symbol", "timestamp", "open", "high", "low", "close", "volume", "vwap", "trade_count", "signed_volume", "buy_volume", "sell_volume", "signed_dollar", "closed")


@dataclass(frozen=True)
class BarSpec:
    """A kind and its one knob; order_col is the tape's order, which Spark's rows do not have."""

    kind: BarKind
    interval: str | None = None
    threshold: float | None = None
    n_ticks: int | None = None
    sign_rule: SignRule = SignRule.TICK_RULE
    symbol_col: str = "symbol"
    timestamp_col: str = "timestamp"
    price_col: str = "price"
    size_col: str = "size"
    bid_col: str = "bid"
    ask_col: str = "ask"
    order_col: str = "seq"

    def __post_init__(self):
        knobs = {BarKind.TIME: "interval", BarKind.TICK: "n_ticks", BarKind.VOLUME: "threshold", BarKind.DOLLAR: "threshold"}
        own = knobs[BarKind(self.kind)]
        for knob in ("interval", "threshold", "n_ticks"):
            if (getattr(self, knob) is not None) != (knob == own):
                raise ValueError(f"{self.kind} bars take {own} and nothing else")
        if own == "interval":
            parse_interval(self.interval)
        elif own == "threshold":
            positive("threshold", self.threshold)
        else:
            at_least("n_ticks", self.n_ticks, 1)


def parse_interval(text: str) -> tuple[int, str]:
    number = text.rstrip("abcdefghijklmnopqrstuvwxyz")
    unit = text[len(number) :]
    if not number.isdigit() or int(number) < 1 or unit not in UNITS or (unit in ("w", "mo") and int(number) != 1):
        raise ValueError(f"{text!r} is no interval such as 30s, 5m, 1h, 1d, 1w or 1mo")
    return int(number), UNITS[unit]


def interval_start(ts: Column, interval: str) -> Column:
    """Start of the left-closed interval; weeks start on Monday."""
    n, unit = parse_interval(interval)
    return F.date_trunc(unit, ts) if unit in ("week", "month") else F.window(ts, f"{n} {unit}")["start"]


def _tape(spec: BarSpec) -> Window:
    return Window.partitionBy(spec.symbol_col).orderBy(spec.timestamp_col, spec.order_col)


def trade_sign(spec: BarSpec, columns: list[str]) -> Column:
    """-1, 0 or +1 of a trade whose tick-rule sign is the column __tick."""
    rule = SignRule(spec.sign_rule)
    if rule is SignRule.NONE:
        return F.lit(0).cast("tinyint")
    if rule is SignRule.TICK_RULE:
        return F.col("__tick")
    if missing := [c for c in (spec.bid_col, spec.ask_col) if c not in columns]:
        raise ValidationError(f"the Lee-Ready rule needs quotes; ticks have no column {', '.join(missing)}")
    p, mid = F.col(spec.price_col), (F.col(spec.bid_col) + F.col(spec.ask_col)) / 2
    return F.when(p > mid, 1).when(p < mid, -1).otherwise(F.col("__tick")).cast("tinyint")


def sign_ticks(ticks: DataFrame, spec: BarSpec) -> DataFrame:
    """ticks with trade_sign: the price change's sign, a zero change keeps the last one, the first is 0."""
    tape = _tape(spec)
    change = F.signum(F.col(spec.price_col) - F.lag(spec.price_col).over(tape))
    moved = ticks.withColumn("__change", F.when(change != 0, change.cast("tinyint")))
    carried = F.last("__change", ignorenulls=True).over(tape.rowsBetween(Window.unboundedPreceding, 0))
    return moved.withColumn("__tick", F.coalesce(carried, F.lit(0)).cast("tinyint")).withColumn("trade_sign", trade_sign(spec, ticks.columns)).drop("__change", "__tick")


def running_sum(ticks: DataFrame, value: Column, spec: BarSpec) -> DataFrame:
    """ticks with __sum, the sum of value along the tape up to and with each trade; nulls add nothing.

    Doubles are added by a tree of 16 children a node: of the rows so far the largest whole nodes come first, single rows
    last. So the rounding error grows with the logarithm of the rows, not with the rows, and is that of DuckDB's
    windowed sum to the last bit, as long as a symbol has under 16 ** (LEVELS + 1) rows and DuckDB sorts it in a group of
    its own (of many symbols several share one, and its tree begins with the group). All windows of one direction
    share one sort.
    """
    bits, inside = 4, Window.unboundedPreceding
    told = ticks.withColumn("__end", F.row_number().over(_tape(spec))).withColumn("__node0", F.coalesce(value, F.lit(0.0)))
    whole = lambda k: F.col("__end").bitwiseAND((1 << bits * k) - 1) == 0
    paths = {"up": F.col("__end") - 1, "down": F.col("__end")}

    def block(way: str, k: int) -> Window:
        """The rows of one node of level k, in an order that begins with the nodes of all levels."""
        path = [F.shiftright(paths[way], bits * x) for x in range(LEVELS, 0, -1)]
        cut = LEVELS - k + 1
        return Window.partitionBy(spec.symbol_col, *path[:cut]).orderBy(*path[cut:], "__end").rowsBetween(inside, 0)

    for k in range(1, LEVELS + 1):  # a node's sum stands in its last row
        told = told.withColumn(f"__node{k}", F.when(whole(k), F.sum(f"__node{k - 1}").over(block("up", k))))
    for k in range(LEVELS, -1, -1):  # a level goes on from the sum of the whole nodes above it
        own = F.when(whole(k), F.col(f"__node{k}"))
        own = own if k == LEVELS else F.when(whole(k + 1), F.col("__sum")).otherwise(own)
        told = told.withColumn("__sum", F.coalesce(F.sum(own).over(block("down", k + 1)), F.lit(0.0)))
    return told.drop("__end", *[f"__node{k}" for k in range(LEVELS + 1)])


def _with_bucket(ticks: DataFrame, spec: BarSpec) -> DataFrame:
    if spec.kind == BarKind.TIME:
        return ticks.withColumn("__bucket", interval_start(F.col(spec.timestamp_col), spec.interval))
    if spec.kind == BarKind.TICK:
        return ticks.withColumn("__bucket", F.floor((F.row_number().over(_tape(spec)) - 1) / F.lit(spec.n_ticks)))
    size = F.col(spec.size_col).cast("double")
    weight = size if spec.kind == BarKind.VOLUME else size * F.col(spec.price_col)
    # the trade that crosses the threshold completes its bar
    return running_sum(ticks, weight, spec).withColumn("__bucket", F.floor((F.col("__sum") - weight) / F.lit(float(spec.threshold)))).drop("__sum")


def build_bars(ticks: DataFrame, spec: BarSpec, validation: ValidationMode = ValidationMode.OFF) -> DataFrame:
    """Bars of each symbol (BAR_COLUMNS); a bar's timestamp is its last trade's, its last bar is not closed.

    Trades of one symbol and timestamp never split over bars. Empty intervals give no bar; no ticks, no bars.
    """
    if spec.symbol_col not in ticks.columns:
        raise ValidationError(f"ticks have no symbol column {spec.symbol_col!r}")
    validate_ticks(ticks, spec, mode=validation)
    signed = _with_bucket(sign_ticks(ticks, spec), spec)
    if spec.kind != BarKind.TIME:
        signed = signed.withColumn("__bucket", F.min("__bucket").over(Window.partitionBy(spec.symbol_col, spec.timestamp_col)))
    p, q, s = F.col(spec.price_col).cast("double"), F.col(spec.size_col).cast("double"), F.col("trade_sign")
    place = F.struct(spec.timestamp_col, spec.order_col)
    total = lambda x: F.coalesce(F.sum(x), F.lit(0.0))
    bars = signed.groupBy(F.col(spec.symbol_col).alias("symbol"), "__bucket").agg(
        F.max(spec.timestamp_col).alias("timestamp"), F.min_by(p, place).alias("open"), F.max(p).alias("high"), F.min(p).alias("low"), F.max_by(p, place).alias("close"), total(q).alias("volume"), total(p * q).alias("__pv"), F.count(F.lit(1)).alias("trade_count"),
        total(q * s).alias("signed_volume"), total(F.when(s > 0, q)).alias("buy_volume"), total(F.when(s < 0, q)).alias("sell_volume"), total(p * q * s).alias("signed_dollar"),
    )
    last = F.max("timestamp").over(Window.partitionBy("symbol"))
    return bars.withColumns({"vwap": F.try_divide(F.col("__pv"), F.col("volume")), "closed": F.col("timestamp") < last}).select(*BAR_COLUMNS)


def asof_quotes(ticks: DataFrame, quotes: DataFrame, spec: BarSpec, quote_order: str = "seq") -> DataFrame:
    """ticks with the last quote at or before each trade: both tapes in one, the quote carried forward."""
    b, a = spec.bid_col, spec.ask_col
    blank = F.lit(None).cast(T.DoubleType())
    rows = F.struct(*ticks.columns)
    left = ticks.select(F.col(spec.symbol_col).alias("__s"), F.col(spec.timestamp_col).alias("__t"), F.lit(1).alias("__kind"), F.col(spec.order_col).alias("__o"), blank.alias(b), blank.alias(a), rows.alias("__row"))
    right = quotes.select(F.col(spec.symbol_col).alias("__s"), F.col(spec.timestamp_col).alias("__t"), F.lit(0).alias("__kind"), F.col(quote_order).alias("__o"), F.col(b).cast("double"), F.col(a).cast("double"), F.lit(None).cast(left.schema["__row"].dataType).alias("__row"))
    upto = Window.partitionBy("__s").orderBy("__t", "__kind", "__o").rowsBetween(Window.unboundedPreceding, 0)
    carried = left.unionByName(right).withColumn("__q", F.last(F.when(F.col("__kind") == 0, F.struct(b, a)), ignorenulls=True).over(upto))
    return carried.where("__kind = 1").select("__row.*", F.col(f"__q.{b}").alias(b), F.col(f"__q.{a}").alias(a))
