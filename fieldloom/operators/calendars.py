"""Which model of month lengths explains day counts: modal residuals by month, and the choice between models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def month_models(df: DataFrame, count: Column, month: Column, models: dict[str, Column]) -> DataFrame:
    """model, month (null: all months), n, least, modal, most, n_modal, unexplained, constant, chosen.

    A model's residual is the stated count less its own; the modal one explains most rows (of several, the least). The model
    that explains most rows with one residual for all months is chosen, of several the first by name. Rows whose count or
    model is null are left out. Rows move as counts by residual.
    """
    each = F.array(*[F.struct(F.lit(k).alias("model"), (count - v).cast("long").alias("residual")) for k, v in models.items()])
    counts = df.select(month.cast("long").alias("month"), F.inline(each)).where("residual is not null").groupBy("model", "month", "residual").agg(F.count(F.lit(1)).alias("n"))
    both = counts.groupingSets([[F.col("model"), F.col("month"), F.col("residual")], [F.col("model"), F.col("residual")]], "model", "month", "residual").agg(F.grouping("month").alias("whole"), F.sum("n").alias("n"))
    best = F.max(F.struct("n", (-F.col("residual")).alias("less")))
    out = both.groupBy("model", "month", "whole").agg(F.sum("n").alias("total"), F.min("residual").alias("least"), F.max("residual").alias("most"), best.alias("best"))
    out = out.select("model", "month", "whole", F.col("total").alias("n"), "least", (-F.col("best.less")).alias("modal"), "most", F.col("best.n").alias("n_modal"), (F.col("total") - F.col("best.n")).alias("unexplained"), (F.col("least") == F.col("most")).alias("constant"))
    # models are few: the best of them over all months
    explained = F.max(F.when(F.col("whole") == 1, F.col("n_modal"))).over(Window.partitionBy())
    first = F.min(F.when((F.col("whole") == 1) & (F.col("n_modal") == F.col("_top")), F.col("model"))).over(Window.partitionBy())
    return out.withColumn("_top", explained).withColumn("chosen", first == F.col("model")).drop("_top", "whole")
