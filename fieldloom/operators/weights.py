"""Group weights and within-cluster transformations.

Few groups and many clusters ask for different plans: group totals are aggregated and joined (small, so Spark broadcasts them by their size), since a window over a
handful of groups would put each of them into one task; cluster means are aggregated and joined by cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.sources.tables import stored

#: Groups up to which their totals are broadcast.
FEW = 10_000


def equal_group_weights(df: DataFrame, group: str, weight: str, scaled: bool = False, name: str = "w") -> DataFrame:
    """Weights that sum to 1 in every group of this sample or, if scaled, to rows / groups."""
    total = df.groupBy(group).agg(F.sum(weight).alias("_t"), F.count(F.lit(1)).alias("_n"))
    if scaled:
        total = stored(total, "group-totals")
        n, k = total.agg(F.sum("_n"), F.count(F.lit(1))).first()
        factor = F.lit(float(n or 0) / max(k, 1))
        total = F.broadcast(total) if k <= FEW else total
    else:
        factor = F.lit(1.0)
    return df.join(total.drop("_n"), group).withColumn(name, F.col(weight) / F.col("_t") * factor).drop("_t")


def drop_singletons(df: DataFrame, cluster: str) -> DataFrame:
    """Only rows of clusters with two rows or more."""
    return df.join(df.groupBy(cluster).agg(F.count(F.lit(1)).alias("_n")).where("_n >= 2").drop("_n"), cluster, "left_semi")


def demean(df: DataFrame, cluster: str, columns: list[str], weight: Column | None = None) -> DataFrame:
    """Replaces columns by their difference from the (weighted) cluster mean."""
    w = F.lit(1.0) if weight is None else weight
    means = df.groupBy(cluster).agg(*[(F.sum(w * F.col(c)) / F.sum(w)).alias(f"_m_{c}") for c in columns])
    out = df.join(means, cluster)
    return out.withColumns({c: F.col(c) - F.col(f"_m_{c}") for c in columns}).drop(*[f"_m_{c}" for c in columns])
