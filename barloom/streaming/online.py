"""Time bars of a tick stream, and features of each closed bar from a bounded history.

Time bars are watermarked tumbling windows: a bar is final when the watermark has passed its end, later ticks are
dropped. Features go through foreachBatch: a micro-batch's symbols are joined with the last rows kept for them, only
as many as the longest history needs, recomputed by the same plan as in batch, and the new rows are written.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.registry import max_min_history
from ..functions.schema import BarSchema
from ..functions.spec import BoundFeature, Recurrence, ValidationMode
from ..operators.bars import BarKind, BarSpec, parse_interval
from ..operators.compute import compute


def stream_time_bars(ticks: DataFrame, spec: BarSpec, watermark: str = "10 minutes") -> DataFrame:
    """Final time bars (symbol, timestamp = end of the interval, OHLC, volume, vwap, trade_count, closed)."""
    if spec.kind != BarKind.TIME:
        raise ValueError("only time bars have an end that a watermark can pass")
    n, unit = parse_interval(spec.interval)
    p, q = F.col(spec.price_col).cast("double"), F.col(spec.size_col).cast("double")
    place = F.struct(spec.timestamp_col, spec.order_col)
    bars = ticks.withWatermark(spec.timestamp_col, watermark).groupBy(F.window(spec.timestamp_col, f"{n} {unit}"), F.col(spec.symbol_col).alias("symbol"))
    made = bars.agg(F.min_by(p, place).alias("open"), F.max(p).alias("high"), F.min(p).alias("low"), F.max_by(p, place).alias("close"), F.sum(q).alias("volume"), F.sum(p * q).alias("pv"), F.count(F.lit(1)).alias("trade_count"))
    return made.select("symbol", F.col("window.end").alias("timestamp"), "open", "high", "low", "close", "volume", F.try_divide("pv", "volume").alias("vwap"), "trade_count", F.lit(True).alias("closed"))


class OnlineFeatures:
    """foreachBatch handler. ``history`` reads the rows kept so far, ``sink`` gets each batch's new feature rows.

    Finite features are exact with ``max_min_history`` rows; recursive ones need those too and agree with the batch
    within their tolerance.
    """

    def __init__(self, features: Sequence[BoundFeature], schema: BarSchema, history_path: str, sink: Callable[[DataFrame, int], None]):
        expanding = [f.spec.name for f in features if f.spec.recurrence is Recurrence.EXPANDING or f.spec.requires_universe]
        if expanding:
            raise ValueError(f"not computable from one symbol's bounded history: {', '.join(expanding)}")
        self.features, self.schema, self.path, self.sink = list(features), schema, history_path, sink
        self.rows = max_min_history(self.features)

    def kept(self, spark, batch: DataFrame, epoch: int) -> DataFrame:
        """The newest state; one folder for each epoch, so a repeated batch starts from the same rows."""
        try:
            return spark.read.schema(batch.schema).parquet(f"{self.path}/epoch={epoch - 1}") if epoch else batch.limit(0)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":  # anything else must not pass for an empty history
                raise
            return batch.limit(0)

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        symbol, time = self.schema.symbol_col, self.schema.timestamp_col
        both = self.kept(spark, batch, epoch).withColumn("__new", F.lit(False)).unionByName(batch.withColumn("__new", F.lit(True)))
        back = F.row_number().over(Window.partitionBy(symbol).orderBy(F.desc(time)))
        both.withColumn("__n", back).where(F.col("__n") <= self.rows).drop("__n", "__new").write.mode("overwrite").parquet(f"{self.path}/epoch={epoch}")
        made = compute(both, *self.features, schema=self.schema, validation=ValidationMode.OFF, keep=["__new"])
        self.sink(made.where("__new").drop("__new"), epoch)
