"""Checks of bars and ticks; all that looks at rows is fused into few aggregations."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import roles as r
from ..functions.schema import BarSchema
from ..functions.spec import BoundFeature, ValidationMode

FLOATS = (T.FloatType, T.DoubleType)
NUMBERS = (*FLOATS, T.ByteType, T.ShortType, T.IntegerType, T.LongType)


class ValidationError(ValueError):
    pass


def _fail(text: str):
    raise ValidationError(text)


def _check_columns(frame: DataFrame, schema: BarSchema, roles: Iterable[r.Role]) -> None:
    types = {f.name: f.dataType for f in frame.schema.fields}
    if schema.timestamp_col not in types:
        _fail(f"the frame has no timestamp column {schema.timestamp_col!r}")
    if not isinstance(types[schema.timestamp_col], T.TimestampType):
        _fail(f"{schema.timestamp_col} must be a timestamp with time zone (UTC), not {types[schema.timestamp_col].simpleString()}")
    zone = frame.sparkSession.conf.get("spark.sql.session.timeZone")
    if zone not in ("UTC", "Etc/UTC", "GMT", "Z", "+00:00"):
        _fail(f"spark.sql.session.timeZone must be UTC, not {zone}")
    for role in sorted(roles, key=str):
        if not schema.has(role):
            _fail(f"role {role} is required but not declared")
        column = schema.column(role)
        if column not in types:
            _fail(f"role {role} is mapped to {column!r}, which the frame does not have")
        kinds = (T.StringType,) if role.kind is r.Kind.CALENDAR else FLOATS if role.is_price else NUMBERS
        if not isinstance(types[column], kinds):
            _fail(f"role {role} ({column}) must be {' or '.join(k.typeName() for k in kinds)}, not {types[column].simpleString()}")
    if schema.symbol_col not in types:
        _fail(f"the frame has no symbol column {schema.symbol_col!r}")
    if not isinstance(types[schema.symbol_col], T.StringType):
        _fail(f"{schema.symbol_col} must be a string, not {types[schema.symbol_col].simpleString()}")


def _ohlc_broken(schema: BarSchema, columns: Sequence[str], strict: bool) -> Column | None:
    """Whether a row's low or high lies inside its open and close, on any basis with all four roles."""
    found = []
    for basis in r.Adjustment:
        four = [r.price(x, basis) for x in ("open", "high", "low", "close")]
        if not all(map(schema.has, four)):
            continue
        names = [schema.column(x) for x in four]
        if missing := [n for n in names if n not in columns]:
            if strict:
                _fail(f"OHLC columns are declared but missing: {', '.join(missing)}")
            continue
        o, h, low, c = map(F.col, names)
        found.append((low > F.least(o, c)) | (h < F.greatest(o, c)))
    return reduce(lambda a, b: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False)), found) if found else None


def _crossed(schema: BarSchema, columns: Sequence[str]) -> Column | None:
    if schema.has(r.BID_RAW) and schema.has(r.ASK_RAW) and {schema.column(r.BID_RAW), schema.column(r.ASK_RAW)} <= set(columns):
        return F.col(schema.column(r.BID_RAW)) > F.col(schema.column(r.ASK_RAW))
    return None


def _any(condition: Column | None) -> Column:
    return F.lit(False) if condition is None else F.coalesce(F.bool_or(condition), F.lit(False))


def incomplete_static(frame: DataFrame, schema: BarSchema, universe: Sequence[str]) -> DataFrame:
    """Times at which the symbols are not exactly the universe."""
    wanted = sorted(set(universe))
    known = F.col(schema.symbol_col).isin(wanted)
    seen = frame.groupBy(schema.timestamp_col).agg(F.countDistinct(F.when(known, F.col(schema.symbol_col))).alias("n"), F.bool_or(~known).alias("other"))
    return seen.where((F.col("n") < len(wanted)) | F.col("other"))


def checked_membership(membership: DataFrame, schema: BarSchema) -> DataFrame:
    """(symbol, start, end): end is exclusive, null is open."""
    types = {f.name: f.dataType for f in membership.schema.fields}
    for name, kind in (("symbol", T.StringType), ("start", T.TimestampType), ("end", T.TimestampType)):
        if not isinstance(types.get(name), kind):
            _fail(f"membership needs a column {name} of type {kind.typeName()}")
    return membership.select(F.col("symbol").alias("__m_symbol"), F.col("start").alias("__m_start"), F.col("end").alias("__m_end"))


def missing_members(frame: DataFrame, schema: BarSchema, membership: DataFrame) -> DataFrame:
    """(symbol, timestamp) of members without a row at a time at which the panel has rows.

    A range join of the distinct times with the intervals: each interval is cut into the calendar months it spans,
    so that both sides meet by month, an equi-join that neither crosses nor broadcasts.
    """
    members = checked_membership(membership, schema)
    times = frame.select(F.col(schema.timestamp_col).alias("__t")).where(F.col("__t").isNotNull()).distinct()
    month = lambda c: (F.year(c) * 12 + F.month(c)).cast("int")
    last = times.agg(F.max("__t").alias("m"), F.min("__t").alias("l")).first()
    if last["m"] is None:
        return times.select(F.lit("").alias(schema.symbol_col), F.col("__t").alias(schema.timestamp_col)).limit(0)
    first = F.greatest(F.col("__m_start"), F.lit(last["l"]))
    until = F.least(F.coalesce(F.col("__m_end"), F.lit(last["m"])), F.lit(last["m"]))
    spans = members.where(first <= until).withColumn("__month", F.explode(F.sequence(month(first), month(until))))
    expected = times.withColumn("__month", month(F.col("__t"))).join(spans, "__month").where((F.col("__t") >= F.col("__m_start")) & (F.col("__m_end").isNull() | (F.col("__t") < F.col("__m_end"))))
    expected = expected.select(F.col("__m_symbol").alias(schema.symbol_col), F.col("__t").alias(schema.timestamp_col)).distinct()
    return expected.join(frame.select(schema.symbol_col, schema.timestamp_col), [schema.symbol_col, schema.timestamp_col], "left_anti")


def validate(frame: DataFrame, *, schema: BarSchema, required_roles: Iterable[r.Role] = (), complete_panel: bool = False, universe: Sequence[str] | None = None, membership: DataFrame | None = None, mode: ValidationMode = ValidationMode.STRICT) -> list[str]:
    """Raises ValidationError at the first breach; with RESEARCH open bars and incomplete panels are returned as texts.

    Rows have no order, so "unsorted" is no fault: a repeated or null (symbol, timestamp) is.
    """
    if mode is ValidationMode.OFF:
        return []
    _check_columns(frame, schema, required_roles)
    keys = [schema.symbol_col, schema.timestamp_col]
    closed = schema.closed_col if schema.closed_col in frame.columns else None
    flags = {
        "broken": _ohlc_broken(schema, frame.columns, strict=True),
        "crossed": _crossed(schema, frame.columns),
        "open": ~F.coalesce(F.col(closed), F.lit(False)) if closed else None,
        "null_key": F.col(keys[0]).isNull() | F.col(keys[1]).isNull(),
    }
    # one pass: per key, then over all
    per_key = frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[_any(c).alias(k) for k, c in flags.items()])
    told = per_key.agg(F.max("n").alias("n"), *[F.bool_or(k).alias(k) for k in flags]).first()
    if told["null_key"]:
        _fail(f"{keys[0]} and {keys[1]} must not be null")
    if (told["n"] or 0) > 1:
        _fail(f"timestamps must be strictly increasing for each symbol: some ({keys[0]}, {keys[1]}) repeat")
    if told["broken"]:
        _fail("low must not be above, nor high below, open and close")
    if told["crossed"]:
        _fail("bid must not be above ask")
    soft = []
    if told["open"]:
        soft.append("some bars are not final (closed is false)")
    if complete_panel or universe is not None or membership is not None:
        if membership is not None:
            if not missing_members(frame, schema, membership).isEmpty():
                soft.append("the panel lacks members at some times")
        elif universe is None:
            _fail("a complete panel needs universe= or membership=")
        elif not incomplete_static(frame, schema, universe).isEmpty():
            soft.append("the panel's symbols are not the universe at some times")
    if soft and mode is ValidationMode.STRICT:
        _fail(soft[0])
    return soft


def validate_ticks(ticks: DataFrame, spec, *, mode: ValidationMode = ValidationMode.STRICT) -> list[str]:
    """The tape's contract: timestamps that do not fall along the tape, price > 0, size >= 0, bid <= ask."""
    if mode is ValidationMode.OFF:
        return []
    types = {f.name: f.dataType for f in ticks.schema.fields}
    for name in (spec.symbol_col, spec.timestamp_col, spec.price_col, spec.size_col, spec.order_col):
        if name not in types:
            _fail(f"ticks have no column {name!r}")
    if not isinstance(types[spec.timestamp_col], T.TimestampType):
        _fail(f"{spec.timestamp_col} must be a timestamp with time zone (UTC), not {types[spec.timestamp_col].simpleString()}")
    tape = Window.partitionBy(spec.symbol_col).orderBy(spec.order_col)
    ts, p, q = F.col(spec.timestamp_col), F.col(spec.price_col), F.col(spec.size_col)
    falls = F.coalesce(ts < F.lag(ts).over(tape), F.lit(False))
    quoted = spec.bid_col in types and spec.ask_col in types
    told = ticks.withColumn("__falls", falls).agg(
        _any(F.col("__falls") | ts.isNull()).alias("order"), _any(~F.coalesce(p > 0, F.lit(False))).alias("price"), _any(~F.coalesce(q >= 0, F.lit(False))).alias("size"), _any(F.col(spec.bid_col) > F.col(spec.ask_col) if quoted else None).alias("quotes")
    ).first()
    for key, text in (("order", "timestamps must not be null nor fall along the tape"), ("price", "prices must be above 0"), ("size", "sizes must be 0 or more"), ("quotes", "bid must not be above ask")):
        if told[key]:
            _fail(text)
    return []


@dataclass(frozen=True)
class FrameAudit:
    rows: int
    symbols: int
    start: object
    end: object
    timestamp_ok: bool
    missing_roles: tuple[str, ...]
    ohlc_violations: int
    duplicate_keys: int
    non_final_bars: int
    completeness: float | None


def audit_frame(frame: DataFrame, *, schema: BarSchema, features: Iterable[BoundFeature] = ()) -> FrameAudit:
    """Counts instead of errors; never raises on what the data hold."""
    columns = set(frame.columns)
    roles = {role for x in features for role in x.spec.input_roles}
    missing = tuple(sorted(str(x) for x in roles if not schema.has(x) or schema.column(x) not in columns))
    keys = [schema.symbol_col, schema.timestamp_col]
    if not set(keys) <= columns:
        return FrameAudit(frame.count(), 0, None, None, False, missing, 0, 0, 0, None)
    broken = _ohlc_broken(schema, frame.columns, strict=False)
    closed = schema.closed_col if schema.closed_col in columns else None
    count = lambda c: F.lit(0) if c is None else F.count_if(c)
    per_key = frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), count(broken).alias("broken"), count(~F.coalesce(F.col(closed), F.lit(False)) if closed else None).alias("open"))
    t = per_key.agg(F.sum("n").alias("rows"), F.countDistinct(keys[0]).alias("symbols"), F.countDistinct(keys[1]).alias("times"), F.count(F.lit(1)).alias("keys"), F.min(keys[1]).alias("start"), F.max(keys[1]).alias("end"), F.sum("broken").alias("broken"), F.sum("open").alias("open")).first()
    cells = t["symbols"] * t["times"]
    return FrameAudit(t["rows"] or 0, t["symbols"], t["start"], t["end"], isinstance(frame.schema[keys[1]].dataType, T.TimestampType), missing, t["broken"] or 0, (t["rows"] or 0) - t["keys"], t["open"] or 0, t["keys"] / cells if cells else None)
