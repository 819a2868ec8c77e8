"""Features of a panel as one lazy plan."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..functions.schema import BarSchema
from ..functions.spec import BoundFeature, ValidationMode, assert_unique
from ..plans.spark import evaluate
from .validate import validate


def compute(frame: DataFrame, *features: BoundFeature, schema: BarSchema, validation: ValidationMode = ValidationMode.STRICT, universe: Sequence[str] | None = None, membership: DataFrame | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """(symbol, timestamp, the columns ``keep``, one column for each feature), in no order.

    Time-series and cross-sectional features share one plan: one exchange by symbol, and one by time if any needs
    it. Checks run first (see validate); with RESEARCH their findings are warnings. Cross-sectional features need a
    universe or a membership table, unless validation is OFF.
    """
    if not features:
        raise ValueError("no features")
    assert_unique(x.spec.name for x in features)
    if validation is not ValidationMode.OFF:
        across = [x.spec.name for x in features if x.spec.requires_universe]
        if across and universe is None and membership is None:
            raise ValueError(f"{', '.join(across)}: pass universe= or membership=")
        roles = {role for x in features for role in x.spec.input_roles}
        for said in validate(frame, schema=schema, required_roles=roles, complete_panel=any(x.spec.requires_complete_panel for x in features), universe=universe, membership=membership, mode=validation):
            warnings.warn(said, stacklevel=2)
    return evaluate(frame, {x.spec.name: x.node(schema) for x in features}, schema.symbol_col, schema.timestamp_col, tuple(keep))


def compute_lazy(frame: DataFrame, *features: BoundFeature, schema: BarSchema) -> DataFrame:
    """Time-series features only, without checks."""
    across = [x.spec.name for x in features if x.spec.requires_universe]
    if across:
        raise ValueError(f"cross-sectional features need compute(): {', '.join(across)}")
    return compute(frame, *features, schema=schema, validation=ValidationMode.OFF)


def since(frame: DataFrame, start, features: Sequence[BoundFeature], schema: BarSchema) -> DataFrame:
    """The rows from ``start`` on and the history that the features need before it, for recomputing the tail only."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from ..functions.registry import max_min_history

    older = F.col(schema.timestamp_col) < F.lit(start)
    back = Window.partitionBy(schema.symbol_col, older).orderBy(F.desc(schema.timestamp_col))
    return frame.withColumn("__back", F.when(older, F.row_number().over(back)).otherwise(0)).where(F.col("__back") < max_min_history(features)).drop("__back")
