"""Design-based means and proportions: strata, clusters, weights, Taylor linearisation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.functions.smallmath import t_quantile


def singleton_strata(df: DataFrame, stratum: str, cluster: str) -> DataFrame:
    """Strata with a single cluster, for which no variance exists; must be empty."""
    return df.groupBy(stratum).agg(F.countDistinct(cluster).alias("n_clusters")).where("n_clusters = 1")


def design_mean(df: DataFrame, y: Column, weight: str, stratum: str, cluster: str, by: list[str] = ()) -> DataFrame:
    """mean, se, df (clusters less strata) and n of a weighted mean, per group.

    The rows are combined to cluster sums once; what follows works on these. The linearised value of a cluster is
    (sum wy - mean * sum w) / W, so one pass over the rows is enough.
    """
    rows = df.select(*by, F.col(stratum).alias("s"), F.col(cluster).alias("c"), F.col(weight).alias("w"), y.cast("double").alias("y")).where("y is not null")
    clusters = rows.groupBy(*by, "s", "c").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("wy"), F.count(F.lit(1)).alias("n"))
    total = clusters.groupBy(*by).agg(F.sum("w").alias("total_w"), (F.sum("wy") / F.sum("w")).alias("mean"))
    both = clusters.join(total, list(by)) if by else clusters.crossJoin(F.broadcast(total))  # the total is one row
    z = both.withColumn("z", (F.col("wy") - F.col("mean") * F.col("w")) / F.col("total_w"))
    strata = z.groupBy(*by, "s").agg(F.var_samp("z").alias("v"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.first("mean").alias("mean"))
    return strata.groupBy(*by).agg(F.first("mean").alias("mean"), F.sqrt(F.sum(F.col("k") * F.col("v"))).alias("se"), (F.sum("k") - F.count(F.lit(1))).alias("df"), F.sum("n").alias("n"))


@F.pandas_udf(T.DoubleType())
def t_half(df: pd.Series) -> pd.Series:
    """How many standard errors a 95 % interval of the t law reaches; one value a distinct number of degrees of freedom."""
    known = {d: t_quantile(0.95, d) if d > 0 else float("nan") for d in df.dropna().unique()}
    return df.map(known)


def logit_interval(p: Column, se: Column, df: Column) -> tuple[Column, Column]:
    """A proportion's interval on the logit scale, with the t law; the proportion itself at 0 and 1."""
    half, centre = t_half(df.cast("double")) * se / (p * (1 - p)), F.log(p / (1 - p))
    inside = (p > 0) & (p < 1)
    return tuple(F.when(inside, 1 / (1 + F.exp(-(centre + s * half)))).otherwise(p) for s in (-1, 1))


def design_proportion(df: DataFrame, y: Column, weight: str, stratum: str, cluster: str, by: list[str] = ()) -> DataFrame:
    """design_mean of a 0/1 value with low and high, its logit interval; groups stay where they are."""
    out = design_mean(df, y, weight, stratum, cluster, by)
    low, high = logit_interval(F.col("mean"), F.col("se"), F.col("df"))
    return out.withColumns({"low": low, "high": high})
