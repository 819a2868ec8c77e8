"""One query for each operator over the driver's tables, with SQL of the same meaning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import families, roles, transforms
from .functions.registry import Registry, daily_core, drop_warmup, max_min_history
from .functions.schema import BarSchema
from .functions.spec import BoundFeature, Family, ValidationMode
from .operators import bars as B
from .operators.compute import compute
from .operators.validate import audit_frame, incomplete_static, missing_members
from .plans import ir, sqltext
from .plans.spark import evaluate
from .sources import panels

Query = Callable[[SparkSession, str], DataFrame]

#: Decimal digits that results are compared at, and what they are multiplied by first.
DIGITS = {"amihud_21": (6, 1e9), "amihud_intraday_78": (6, 1e6), "dollar_vol": (1, 1), "adv_21": (1, 1), "signed_vol_21": (2, 1), "kyle_lambda_78": (6, 1), "rvar_78": (6, 1)}
PRICES = {"atr_14": 4, "sma_50": 4, "sma_200": 4, "ema_12": 4, "ema_26": 4, "macd_12_26_9": 4, "macd_signal_12_26_9": 4, "macd_hist_12_26_9": 4, "roll_spread_21": 4, "zscore_close_21": 5}


def key_columns() -> list:
    return ["symbol", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp")]


SQL_KEYS = "symbol, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp"


def place(feature: BoundFeature):
    """(frame, schema, SQL, name of the CTE) on which a feature is shown."""
    if feature.spec.family is Family.MICROSTRUCTURE:
        deep = {role: str(role).split("@")[0] for role in feature.spec.input_roles if role.kind is roles.Kind.DEPTH}
        return panels.intraday, BarSchema({**panels.INTRADAY.roles, **deep}), panels.INTRADAY_SQL, "intraday"
    if feature.spec.requires_universe:
        return panels.weekly, panels.WEEKLY, panels.WEEKLY_SQL, "weekly"
    return panels.daily, panels.DAILY, panels.DAILY_SQL, "daily"


def shown(value, digits: int, scale: float = 1):
    """value * scale to so many digits, for a column or for SQL text. A shift keeps amounts of few decimals off ties."""
    shift = 0.0123456789 * 10.0**-digits
    if isinstance(value, str):
        return f"round({value} * {float(scale)!r} + {shift!r}, {digits}) + 0.0"
    return F.round(value * float(scale) + shift, digits) + 0.0


def rounded(feature: BoundFeature, value):
    digits, scale = DIGITS.get(feature.spec.name, (PRICES.get(feature.spec.name, 6), 1))
    if feature.spec.output_dtype.typeName() in ("byte", "boolean"):
        return value
    return shown(value, digits, scale)


def feature_query(feature: BoundFeature) -> tuple[Query, str]:
    frame, schema, sql, cte = place(feature)
    name = feature.spec.name

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = compute(frame(spark, sf_dir), feature, schema=schema, validation=ValidationMode.OFF)
        return made.select(*key_columns(), rounded(feature, F.col(name)).alias(name))

    steps, final = sqltext.evaluate(cte, {name: feature.node(schema)}, "symbol", "timestamp", f"{SQL_KEYS}, {rounded(feature, '{' + name + '}')} AS {name}")
    return run, f"WITH {sql}{', ' + steps if steps else ''} {final}"


def transform_query(transform: transforms.BoundTransform) -> tuple[Query, str]:
    name = transform.spec.name
    node = transform.node(ir.src("close"))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = evaluate(panels.weekly(spark, sf_dir), {name: node}, "symbol", "timestamp")
        return made.select(*key_columns(), shown(F.col(name), 4).alias(name))

    steps, final = sqltext.evaluate("weekly", {name: node}, "symbol", "timestamp", f"{SQL_KEYS}, {shown('{' + name + '}', 4)} AS {name}")
    return run, f"WITH {panels.WEEKLY_SQL}, {steps} {final}"


KNOBS = {"time": ("interval", "1h", "1 hour"), "tick": ("n_ticks", 10, 10), "volume": ("threshold", 500.0, 500.0), "dollar": ("threshold", 20000.0, 20000.0)}


def bars_query(kind: str, rule: str) -> tuple[Query, str]:
    knob, value, text = KNOBS[kind]
    numbers = [c for c in B.BAR_COLUMNS if c not in ("symbol", "timestamp", "trade_count", "closed")]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = B.build_bars(panels.ticks(spark, sf_dir), B.BarSpec(kind, sign_rule=rule, **{knob: value}))
        return made.select(*key_columns(), *[shown(F.col(c), 5).alias(c) for c in numbers], "trade_count", "closed")

    return run, f"WITH {panels.TICKS_SQL}, {panels.bars_sql(kind, text, rule)} SELECT {SQL_KEYS}, {', '.join(f'{shown(c, 5)} AS {c}' for c in numbers)}, trade_count, closed FROM bars"


def everything(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All daily features in one plan."""
    found = [f for f in families.default_features() if f.spec.family is not Family.MICROSTRUCTURE and not f.spec.requires_universe]
    made = compute(panels.daily(spark, sf_dir), *found, schema=panels.DAILY, validation=ValidationMode.OFF)
    return made.select(*key_columns(), *[rounded(f, F.col(f.spec.name)).alias(f.spec.name) for f in found])


def everything_sql() -> str:
    found = [f for f in families.default_features() if f.spec.family is not Family.MICROSTRUCTURE and not f.spec.requires_universe]
    steps, final = sqltext.evaluate("daily", {f.spec.name: f.node(panels.DAILY) for f in found}, "symbol", "timestamp", ", ".join([SQL_KEYS, *[f"{rounded(f, '{' + f.spec.name + '}')} AS {f.spec.name}" for f in found]]))
    return f"WITH {panels.DAILY_SQL}, {steps} {final}"


def panel_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days on which the order priorities are not all there."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").cast("timestamp").alias("timestamp")).distinct()
    found = incomplete_static(orders, panels.WEEKLY, ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"])
    return found.select(F.date_format("timestamp", "yyyy-MM-dd").alias("day"), "n")


PANEL_GAPS_SQL = "SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY o_orderdate HAVING count(DISTINCT o_orderpriority) < 5"


def membership_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members without a row: every priority is a member from its first order to its last, exclusively."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").cast("timestamp").alias("timestamp")).distinct()
    members = orders.groupBy("symbol").agg(F.min("timestamp").alias("start"), F.max("timestamp").alias("end"))
    return missing_members(orders, panels.WEEKLY, members).select("symbol", F.date_format("timestamp", "yyyy-MM-dd").alias("day"))


MEMBERSHIP_GAPS_SQL = """WITH o AS (SELECT DISTINCT o_orderpriority AS symbol, o_orderdate AS t FROM orders), m AS (SELECT symbol, min(t) AS b, max(t) AS e FROM o GROUP BY symbol), times AS (SELECT DISTINCT t FROM o)
SELECT m.symbol, strftime(times.t, '%Y-%m-%d') AS day FROM m JOIN times ON times.t >= m.b AND times.t < m.e ANTI JOIN o ON o.symbol = m.symbol AND o.t = times.t"""


def quotes_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each trade of one type with the last quote of the same user before it or then."""
    events = panels.ticks(spark, sf_dir)
    spec = B.BarSpec("tick", n_ticks=1)
    quotes = events.where("seq % 3 = 0").select("symbol", "timestamp", "bid", "ask", "seq")
    trades = events.where("seq % 3 <> 0").drop("bid", "ask")
    return B.asof_quotes(trades, quotes, spec).select("seq", "symbol", F.round("bid", 4).alias("bid"), F.round("ask", 4).alias("ask"))


QUOTES_ASOF_SQL = f"""WITH {panels.TICKS_SQL} SELECT t.seq, t.symbol, round(q.bid, 4) AS bid, round(q.ask, 4) AS ask
FROM (SELECT * FROM ticks WHERE seq % 3 <> 0) t ASOF LEFT JOIN (SELECT * FROM ticks WHERE seq % 3 = 0) q ON t.symbol = q.symbol AND t.timestamp >= q.timestamp"""


def signed_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each trade's sign by the Lee-Ready rule."""
    return B.sign_ticks(panels.ticks(spark, sf_dir), B.BarSpec("tick", n_ticks=1, sign_rule="lee_ready")).select("seq", F.col("trade_sign").cast("int").alias("trade_sign"))


SIGNED_TICKS_SQL = f"WITH {panels.TICKS_SQL}, {panels.bars_sql('tick', 1, 'lee_ready')} SELECT seq, CAST(s AS INTEGER) AS trade_sign FROM signed"


def past_warmup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars without the rows that a bundle's longest history takes."""
    return drop_warmup(panels.daily(spark, sf_dir), daily_core(), panels.DAILY).select(*key_columns(), shown(F.col("close"), 4).alias("close"))


PAST_WARMUP_SQL = f"""WITH {panels.DAILY_SQL}, numbered AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY timestamp) AS n FROM daily)
SELECT {SQL_KEYS}, {shown('close', 4)} AS close FROM numbered WHERE n > {max_min_history(daily_core())}"""


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of the closed hourly bars."""
    told = audit_frame(panels.intraday(spark, sf_dir), schema=panels.INTRADAY)
    row = (told.rows, told.symbols, told.ohlc_violations, told.duplicate_keys, told.non_final_bars, float(round(told.completeness, 9)))
    return spark.createDataFrame([row], "n_rows long, symbols long, ohlc_violations long, duplicate_keys long, non_final_bars long, completeness double")


AUDIT_SQL = f"""WITH {panels.INTRADAY_SQL}
SELECT count(*) AS n_rows, count(DISTINCT symbol) AS symbols, count(*) FILTER (low > least(open, close) OR high < greatest(open, close)) AS ohlc_violations,
  count(*) - count(DISTINCT (symbol, timestamp)) AS duplicate_keys, count(*) FILTER (NOT closed) AS non_final_bars, round(count(DISTINCT (symbol, timestamp)) / (count(DISTINCT symbol) * count(DISTINCT timestamp)), 9) AS completeness
FROM intraday"""


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry as a table."""
    return Registry.default().frame(spark)


def _all() -> dict[str, tuple[Query, str]]:
    found = {f"feature_{f.spec.name}": feature_query(f) for f in [*families.default_features(), families.book_imbalance()]}
    four = (transforms.zscore(21), transforms.xs_zscore(), transforms.xs_rank(), transforms.frac_diff(0.4))
    found |= {f"transform_{t.spec.name}": transform_query(t) for t in four}
    found["transform_xs_zscore_winsorized"] = transform_query(transforms.xs_zscore(1.0))
    found |= {f"bars_{kind}_{rule}": bars_query(kind, rule) for kind in KNOBS for rule in panels.SIGN_SQL}
    return found | {
        "all_daily_features": (everything, everything_sql()),
        "panel_gaps": (panel_gaps, PANEL_GAPS_SQL),
        "membership_gaps": (membership_gaps, MEMBERSHIP_GAPS_SQL),
        "quotes_asof": (quotes_asof, QUOTES_ASOF_SQL),
        "signed_ticks": (signed_ticks, SIGNED_TICKS_SQL),
        "past_warmup": (past_warmup, PAST_WARMUP_SQL),
        "audit": (audit, AUDIT_SQL),
    }


def queries() -> dict[str, Query]:
    return {name: run for name, (run, _) in _all().items()} | {"catalogue": catalogue}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items()}
