"""Normalisers of a column: trailing and cross-sectional scores, ranks, fractional differences."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..plans.ir import Node, lag, rank_across, rolling, src, zscore_across
from ..plans.spark import evaluate
from .schema import BarSchema
from .spec import REQUIRE_FULL_WINDOW, NullPolicy, Params, Unit, at_least, compose_name, fingerprint, inside, positive


@dataclass(frozen=True)
class TransformSpec:
    name: str
    version: int
    fingerprint: str
    lookback: int | None
    min_history: int
    null_policy: NullPolicy
    output_unit: Unit
    params: Params
    causal: bool = True


@dataclass(frozen=True)
class BoundTransform:
    spec: TransformSpec
    node: Callable[[Node], Node]

    def apply(self, frame: DataFrame, column: str, schema: BarSchema, out: str | None = None, over: str | None = None) -> DataFrame:
        """The frame with one more column, by the schema's symbol and time.

        ``over`` names another column to group by: in place of the symbol for trailing transforms, in place of the
        time for those across symbols.
        """
        by, time = schema.symbol_col, schema.timestamp_col
        if over is not None:
            by, time = (over, time) if self.spec.lookback is not None else (by, over)
        keep = tuple(c for c in frame.columns if c not in (by, time))
        return evaluate(frame, {out or f"{column}_{self.spec.name}": self.node(src(column))}, by, time, keep)


def _bound(name: str, node, params: Params, lookback: int | None, min_history: int, unit: Unit) -> BoundTransform:
    spec = TransformSpec(name, 1, fingerprint(name, 1, params, (), node(src("x")).key), lookback, min_history, REQUIRE_FULL_WINDOW, unit, params)
    return BoundTransform(spec, node)


def zscore(window: int) -> BoundTransform:
    """Against the mean and sample deviation of the last ``window`` rows of the symbol; null where flat."""
    at_least("window", window, 2)
    return _bound(f"zscore_{window}", lambda x: (x - rolling("avg", x, window)) / rolling("stddev_samp", x, window), Params(window=window), window, window, Unit.ZSCORE)


def xs_zscore(winsorize: float | None = None) -> BoundTransform:
    """Across symbols at one time; values are first clipped to mean +/- winsorize deviations, if given."""
    k = None if winsorize is None else positive("winsorize", winsorize)
    return _bound("xs_zscore", lambda x: zscore_across(x, k), Params(winsorize=k), None, 1, Unit.ZSCORE)


def xs_rank() -> BoundTransform:
    """Average rank over the number of known values at one time, in (0, 1]."""
    return _bound("xs_rank", rank_across, Params(), None, 1, Unit.RANK_0_1)


def fractional_weights(d: float, threshold: float, max_lag: int) -> list[float]:
    """Binomial weights of (1 - B)**d until one is below the threshold."""
    weights = [1.0]
    while len(weights) <= max_lag:
        k = len(weights)
        following = weights[-1] * (k - 1 - d) / k
        if abs(following) < threshold:
            break
        weights.append(following)
    return weights


def frac_diff(d: float, threshold: float = 1e-6, max_lag: int = 100) -> BoundTransform:
    """Fractional difference of order d in [0, 2): the sum of the weights times the values so many rows back."""
    d, threshold = (inside("d", d, -1e-12, 2) if d else 0.0), positive("threshold", threshold)
    weights = fractional_weights(d, threshold, at_least("max_lag", max_lag, 1))

    def node(x: Node) -> Node:
        return sum((lag(x, k) * w for k, w in enumerate(weights[1:], 1)), start=x * weights[0])

    return _bound(compose_name("frac_diff", float(d)), node, Params(d=float(d), threshold=threshold, max_lag=max_lag), len(weights), len(weights), Unit.UNITLESS)
