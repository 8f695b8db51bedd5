"""Demeaning on two classifications by alternating projections, on the sums of their cells.

The first classification has many levels (clusters), the second few (years). Rows are summed by cell once, and the cells of a
cluster lie together in one row of a written table. A pass takes cluster means and then means of the second classification of
what is left; it reads that table and returns a number a level of the second, so passes neither join nor lengthen the plan.
Rows are met once, at the end.

Rows with a missing or NaN value, or without either level, are left out of the fit; they keep a missing value.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.sources.tables import stored

#: Levels of the second classification, of all groups together.
MOST_LEVELS = 10_000


@dataclass
class TwoWay:
    """clusters: _by, _first, effect and cells (i, n, m, v: level, rows, mean, squares around it); effects of the levels, in order;
    moved: the largest change of one in the last pass."""

    clusters: DataFrame
    levels: list[tuple[str, str]]
    effects: list[float]
    passes: int
    moved: float

    def effect(self, i: Column) -> Column:
        return F.get(_array(self.effects), i)

    def spread(self) -> DataFrame:
        """Per group: rows, clusters, clusters_2plus, within (squares around cluster means, of clusters of two rows and more), left (squares
        after both)."""
        total = lambda value: F.aggregate("cells", F.lit(0.0), lambda s, x: s + value(x))
        n = total(lambda x: x["n"].cast("double"))
        mean = total(lambda x: x["n"] * x["m"]) / n
        rows = self.clusters.withColumns({"n": n, "mean": mean})
        around = total(lambda x: x["v"] + x["n"] * (x["m"] - F.col("mean")) * (x["m"] - F.col("mean")))
        left = lambda x: x["m"] - F.col("effect") - self.effect(x["i"])
        rest = total(lambda x: x["v"] + x["n"] * left(x) * left(x))
        multi = F.col("n") >= 2
        return rows.groupBy("_by").agg(F.sum("n").cast("long").alias("n"), F.count(F.lit(1)).alias("clusters"), F.count_if(multi).alias("clusters_2plus"), F.sum(F.when(multi, F.col("n"))).cast("long").alias("n_2plus"), F.sum(F.when(multi, around)).alias("within"), F.sum(rest).alias("left"))


def _array(values: list[float]) -> Column:
    return F.from_json(F.lit(json.dumps(values)), "array<double>")


def fit_two_way(df: DataFrame, first: str, second: str, column: str, by: str | None = None, passes: int = 25, tolerance: float = 0.0) -> TwoWay:
    """Alternating projections within each level of by; stops early once no effect of the second moves by more than tolerance."""
    number = F.nanvl(F.col(column).cast("double"), F.lit(None))
    rows = df.select((F.col(by).cast("string") if by else F.lit("")).alias("_by"), F.col(first).alias("_first"), F.col(second).cast("string").alias("_second"), number.alias("_x")).na.drop()
    cells = rows.groupBy("_by", "_first", "_second").agg(F.count(F.lit(1)).alias("n"), F.avg("_x").alias("m"), (F.var_pop("_x") * F.count(F.lit(1))).alias("v"))
    cells = stored(cells, "two-way-cells")
    levels = sorted(tuple(r) for r in cells.select("_by", "_second").distinct().limit(MOST_LEVELS + 1).collect())
    if len(levels) > MOST_LEVELS:
        raise ValueError(f"over {MOST_LEVELS} levels")
    places = df.sparkSession.createDataFrame([(*x, i) for i, x in enumerate(levels)] or [("", "", 0)], "_by string, _second string, i int")
    clusters = cells.join(F.broadcast(places), ["_by", "_second"]).groupBy("_by", "_first").agg(F.collect_list(F.struct("i", "n", "m", "v")).alias("cells"))
    clusters = stored(clusters, "two-way-clusters")
    effects, before, moved, done = [0.0] * len(levels), [0.0] * len(levels), 0.0, 0

    def centred(values: list[float]) -> DataFrame:
        array = _array(values)
        own = F.aggregate("cells", F.lit(0.0), lambda s, x: s + x["n"] * (x["m"] - F.get(array, x["i"])))
        return clusters.withColumn("effect", own / F.aggregate("cells", F.lit(0.0), lambda s, x: s + x["n"]))

    while done < passes and levels:
        before, array = effects, _array(effects)
        left = centred(before).select("effect", F.explode("cells").alias("x"))
        change = left.groupBy("x.i").agg(F.sum(F.col("x.n") * (F.col("x.m") - F.col("effect") - F.get(array, F.col("x.i")))) / F.sum("x.n")).collect()
        effects = list(before)
        for i, v in change:
            effects[i] += v
        done, moved = done + 1, max((abs(v) for _, v in change), default=0.0)
        if moved <= tolerance:
            break
    return TwoWay(centred(before), levels, effects, done, moved)


def demean_two_way(df: DataFrame, first: str, second: str, column: str, passes: int = 25, tolerance: float = 0.0) -> DataFrame:
    """df with column replaced by what is left of it after both classifications."""
    fit = fit_two_way(df, first, second, column, None, passes, tolerance)
    levels = df.sparkSession.createDataFrame([(second, e) for (_, second), e in zip(fit.levels, fit.effects, strict=True)] or [("", 0.0)], "_second string, _b double")
    own = fit.clusters.select(F.col("_first"), F.col("effect").alias("_a"))
    out = df.join(own, df[first] == own["_first"], "left").join(F.broadcast(levels), F.col(second).cast("string") == F.col("_second"), "left")
    return out.withColumn(column, F.nanvl(F.col(column).cast("double"), F.lit(None)) - F.col("_a") - F.col("_b")).select(df.columns)
