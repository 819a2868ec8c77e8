"""Renders nodes as ANSI SQL text, so that another engine can confirm the results."""

from __future__ import annotations

from collections.abc import Mapping

from .ir import Node
from .spark import layers

_MAPS = {
    "add": "({} + {})",
    "sub": "({} - {})",
    "mul": "({} * {})",
    "div": "({} / nullif(CAST({} AS DOUBLE), 0))",
    "lt": "({} < {})",
    "le": "({} <= {})",
    "eq": "({} = {})",
    "and": "({} AND {})",
    "or": "({} OR {})",
    "isnull": "({} IS NULL)",
    "known": "({} IS NOT NULL)",
    "when": "CASE WHEN {} THEN {} ELSE {} END",
    "exp": "exp({})",
    "abs": "abs({})",
    "sign": "CAST(sign({}) AS DOUBLE)",
    "floor": "floor({})",
    "or0": "coalesce({}, 0)",
    "weekday": "CAST(isodow({}) - 1 AS TINYINT)",
    "dayofmonth": "day({})",
    "monthdays": "day(last_day({}))",
}
_ROLLS = {"skew": "skewness", "kurt": "kurtosis_pop"}


def literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, float):
        return f"CAST({x!r} AS DOUBLE)"
    return str(x)


class Text:
    def __init__(self, symbol: str, time: str):
        self.symbol, self.time, self.named = symbol, time, {}

    def column(self, x: Node) -> str:
        if x.key in self.named:
            return self.named[x.key]
        if x.op == "src":
            return x.params[0]
        if x.op == "lit":
            return literal(x.params[0])
        args = [self.column(a) for a in x.args]
        if x.op == "ln":
            return f"CASE WHEN {args[0]} > 0 THEN ln({args[0]}) END"
        if x.op == "sqrt":
            return f"CASE WHEN {args[0]} >= 0 THEN sqrt({args[0]}) END"
        if x.op in ("greatest", "least"):
            return f"{x.op}({', '.join(args)})"
        return _MAPS[x.op].format(*args)

    def window(self, x: Node) -> str:
        args, p = [self.column(a) for a in x.args], x.params
        along = f"PARTITION BY {self.symbol} ORDER BY {self.time}"
        upto = f"{along} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
        last = lambda n: f"{along} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW"
        match x.op:
            case "lag":
                return f"lag({args[0]}, {p[0]}) OVER ({along})"
            case "roll":
                what, n = p
                over = f"({args[0]}) OVER ({last(n)})"
                if what == "skew":  # from the sample's estimate to the population's
                    return f"CASE WHEN var_pop{over} > 0 THEN skewness{over} * {(n - 2) / (n * (n - 1)) ** 0.5!r} END"
                if what == "kurt":
                    return f"CASE WHEN var_pop{over} > 0 THEN kurtosis_pop{over} END"
                return f"{what}{over}"
            case "roll2":
                return f"covar_pop({args[0]}, {args[1]}) OVER ({last(p[1])})"
            case "count":
                return f"count({args[0]}) OVER ({last(p[0])})"
            case "count2":
                return f"count({args[0]} * {args[1]}) OVER ({last(p[0])})"
            case "rownum":
                return f"row_number() OVER ({along})"
            case "runsum":
                return f"sum({args[0]}) OVER ({upto})"
            case "runcount":
                return f"count({args[0]}) OVER ({upto})"
            case "lastbefore":
                return f"last_value({args[0]} IGNORE NULLS) OVER ({along} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
            case "lastupto":
                return f"last_value({args[0]} IGNORE NULLS) OVER ({upto})"
            case "blockrun":
                return f"sum({args[0]}) OVER (PARTITION BY {self.symbol}, {args[1]} ORDER BY {self.time} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
            case "blockprev":
                return f"sum({args[0]}) OVER (PARTITION BY {self.symbol} ORDER BY {args[1]} RANGE BETWEEN {p[0]} PRECEDING AND {p[0]} PRECEDING)"
            case "pctile":
                return f"len(list_filter(list({args[0]}) OVER ({last(p[0])}), lambda v: v <= {args[0]})) / CAST({p[0]} AS DOUBLE)"
            case "mad":
                return f"list_sum(list_transform(list({args[0]}) OVER ({last(p[0])}), lambda v: abs(v - {args[1]}))) / {p[0]}"
            case "xs":
                return f"{p[0]}({args[0]}) OVER (PARTITION BY {self.time})"
            case "xsrank":
                order = f"PARTITION BY {self.time} ORDER BY {args[0]} NULLS LAST"
                return f"rank() OVER ({order}) + (count(*) OVER (PARTITION BY {self.time}, {args[0]}) - 1) / 2.0"
        raise ValueError(x.op)


def evaluate(source: str, outputs: Mapping[str, Node], symbol: str, time: str, final: str) -> str:
    """A WITH query over the CTE or table ``source``. ``final`` is its select list, with {name} for each output."""
    state = Text(symbol, time)
    steps, now = [], source
    for k, (feeds, windows) in enumerate(layers(outputs.values())):
        for kind, nodes, render in (("m", feeds, state.column), ("w", windows, state.window)):
            if nodes:
                steps.append(f"{kind}{k} AS (SELECT *, {', '.join(f'{render(x)} AS {kind}_{x.key}' for x in nodes)} FROM {now})")
                state.named |= {x.key: f"{kind}_{x.key}" for x in nodes}
                now = f"{kind}{k}"
    columns = final.format(**{name: state.column(x) for name, x in outputs.items()})
    return (", ".join(steps), f"SELECT {columns} FROM {now}")
