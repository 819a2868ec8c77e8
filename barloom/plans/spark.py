"""Compiles nodes to layered Spark projections: one layer of windows for each depth."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ir import WINDOWS, Node

_MAPS = {
    "add": lambda a, b: a + b,
    "sub": lambda a, b: a - b,
    "mul": lambda a, b: a * b,
    "div": lambda a, b: F.try_divide(a, b),
    "lt": lambda a, b: a < b,
    "le": lambda a, b: a <= b,
    "eq": lambda a, b: a == b,
    "and": lambda a, b: a & b,
    "or": lambda a, b: a | b,
    "isnull": lambda a: a.isNull(),
    "known": lambda a: a.isNotNull(),
    "when": lambda c, a, b: F.when(c, a).otherwise(b),
    "ln": F.ln,  # null where the argument is not positive
    "sqrt": lambda a: F.when(a >= 0, F.sqrt(a)),
    "exp": F.exp,
    "abs": F.abs,
    "sign": F.signum,
    "floor": lambda a: F.floor(a).cast("double"),
    "or0": lambda a: F.coalesce(a, F.lit(0.0)),
    "greatest": F.greatest,
    "least": F.least,
    "weekday": lambda a: F.weekday(a).cast("tinyint"),
    "dayofmonth": F.dayofmonth,
    "monthdays": lambda a: F.dayofmonth(F.last_day(a)),
}
_ROLLS = {
    "avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "stddev_samp": F.stddev_samp, "stddev_pop": F.stddev_pop,
    "var_samp": F.var_samp, "var_pop": F.var_pop, "skew": F.skewness, "kurt": F.kurtosis, "count": F.count,
}


class Layers:
    """Names for the columns of window nodes, and of what feeds them."""

    def __init__(self, symbol: str, time: str):
        self.symbol, self.time = symbol, time
        self.named: dict[str, str] = {}
        self.along = Window.partitionBy(symbol).orderBy(time)
        self.across = Window.partitionBy(time)

    def column(self, x: Node) -> Column:
        if x.key in self.named:
            return F.col(self.named[x.key])
        if x.op == "src":
            return F.col(f"`{x.params[0]}`")
        if x.op == "lit":
            return F.lit(x.params[0])
        return _MAPS[x.op](*map(self.column, x.args))

    def window(self, x: Node) -> Column:
        args, p, w = [self.column(a) for a in x.args], x.params, self.along
        upto = w.rowsBetween(Window.unboundedPreceding, 0)
        last = lambda n: w.rowsBetween(1 - n, 0)
        match x.op:
            case "lag":
                return F.lag(args[0], p[0]).over(w)
            case "roll":
                return _ROLLS[p[0]](args[0]).over(last(p[1]))
            case "roll2":
                return F.covar_pop(*args).over(last(p[1]))
            case "count":
                return F.count(args[0]).over(last(p[0]))
            case "count2":
                return F.count(args[0] * args[1]).over(last(p[0]))
            case "rownum":
                return F.row_number().over(w)
            case "runsum":
                return F.sum(args[0]).over(upto)
            case "runcount":
                return F.count(args[0]).over(upto)
            case "lastbefore":
                return F.last(args[0], ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
            case "lastupto":
                return F.last(args[0], ignorenulls=True).over(upto)
            case "blockrun":
                # the symbol's partitioning serves (symbol, block) too: a sort, no exchange
                return F.sum(args[0]).over(Window.partitionBy(self.symbol, args[1]).orderBy(self.time).rowsBetween(Window.unboundedPreceding, 0))
            case "blockprev":
                return F.sum(args[0]).over(Window.partitionBy(self.symbol).orderBy(args[1]).rangeBetween(-p[0], -p[0]))
            case "pctile":
                return F.size(F.filter(F.collect_list(args[0]).over(last(p[0])), lambda v: v <= args[0])) / F.lit(float(p[0]))
            case "mad":
                values = F.collect_list(args[0]).over(last(p[0]))
                return F.aggregate(values, F.lit(0.0), lambda s, v: s + F.abs(v - args[1])) / F.lit(float(p[0]))
            case "xs":
                return _ROLLS[p[0]](args[0]).over(self.across)
            case "xsrank":
                ordered = self.across.orderBy(args[0].asc_nulls_last())
                ties = F.count(F.lit(1)).over(ordered.rangeBetween(0, 0))
                return F.rank().over(ordered) + (ties - 1) / F.lit(2.0)
        raise ValueError(x.op)


def walk(roots) -> list[Node]:
    """Every node once, arguments first."""
    seen: dict[str, Node] = {}

    def visit(x: Node):
        if x.key not in seen:
            for a in x.args:
                visit(a)
            seen[x.key] = x

    for r in roots:
        visit(r)
    return list(seen.values())


def layers(roots) -> list[tuple[list[Node], list[Node]]]:
    """By depth: the row-wise nodes that feed its windows, and its windows (along symbols before across them)."""
    windows = [x for x in walk(roots) if x.op in WINDOWS]
    out: list[tuple[list[Node], list[Node]]] = []
    fed: set[str] = set()
    for depth in sorted({x.depth for x in windows}):
        here = [x for x in windows if x.depth == depth]
        feeds = {a.key: a for x in here for a in x.args if a.op not in WINDOWS and a.op not in ("src", "lit") and a.key not in fed}
        fed |= feeds.keys()
        out.append((list(feeds.values()), here))
    return out


def evaluate(frame: DataFrame, outputs: Mapping[str, Node], symbol: str, time: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """frame's keys (and the columns ``keep``) with one column for each output; one exchange by symbol, one by time.

    Names that the frame has already do not clash with inner ones. Rows come in no order.
    """
    state = Layers(symbol, time)
    sources = {x.params[0] for x in walk(outputs.values()) if x.op == "src"}
    df = frame.select(*dict.fromkeys([symbol, time, *keep, *sorted(sources)]))
    for feeds, windows in layers(outputs.values()):
        if feeds:
            df = df.select("*", *[state.column(x).alias(f"__m_{x.key}") for x in feeds])
            state.named |= {x.key: f"__m_{x.key}" for x in feeds}
        df = df.select("*", *[state.window(x).alias(f"__w_{x.key}") for x in windows])
        state.named |= {x.key: f"__w_{x.key}" for x in windows}
    return df.select(*dict.fromkeys([symbol, time, *keep]), *[state.column(x).alias(name) for name, x in outputs.items()])


def all_of(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions)
