"""Final tables as cells: panels of terms, information rows, sizes and notes, built from stored result tables.

Every builder returns rows (panel, place, row, column, cell), so that tables of different shapes stack in one; wide turns one
table's cells into its columns. Result tables of models have a row a term: model, scope, term, beta, se, low, high, n, clusters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELLS = ["panel", "place", "row", "column", "cell"]


def estimate(style: str, digits: int) -> Column:
    """coefficient (standard error), or coefficient [interval]; empty without an estimate."""
    number = f"%.{digits}f"
    made = F.format_string(f"{number} ({number})", "beta", "se") if style == "se" else F.format_string(f"{number} [{number}, {number}]", "beta", "low", "high")
    return F.when(F.col("beta").isNotNull(), made).otherwise("")


def models_panel(results: DataFrame, panel: str, column: str, terms: dict[str, str], info: dict[str, list[str]] | None = None, style: str = "se", digits: int = 3, sizes: bool = True) -> DataFrame:
    """One panel whose columns are models or scopes: a row a term (in the order of terms: name to label; empty where a model does
    not have it), a row a piece of information (label to terms of which a model has at least one: Yes or No), N and clusters."""
    rows = results.withColumn("_column", F.col(column).cast("string"))
    listed = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(t).alias("term"), F.lit(label).alias("row")) for i, (t, label) in enumerate(terms.items())])
    cells = F.collect_list(F.when(F.col("term").isin(*terms), F.struct("term", estimate(style, digits).alias("cell"))))
    held = F.collect_set("term")
    models = rows.groupBy("_column").agg(cells.alias("cells"), held.alias("held"), F.max("n").alias("n"), F.max("clusters").alias("clusters"))
    own = lambda t: F.coalesce(F.get(F.transform(F.filter("cells", lambda x: x["term"] == t["term"]), lambda x: x["cell"]), F.lit(0)), F.lit(""))
    parts = [F.transform(listed, lambda t: F.struct(t["place"].alias("place"), t["row"].alias("row"), own(t).alias("cell")))]
    more = [(label, F.when(F.arrays_overlap("held", F.array(*map(F.lit, names))), "Yes").otherwise("No")) for label, names in (info or {}).items()]
    more += [("N", F.col("n").cast("string")), ("Clusters", F.col("clusters").cast("string"))] if sizes else []
    if more:
        parts.append(F.array(*[F.struct(F.lit(len(terms) + i).alias("place"), F.lit(label).alias("row"), F.coalesce(v, F.lit("")).alias("cell")) for i, (label, v) in enumerate(more)]))
    return models.select(F.lit(panel).alias("panel"), F.col("_column").alias("column"), F.inline(F.concat(*parts))).select(*CELLS)


def records_panel(df: DataFrame, panel: str, keys: list[str], digits: dict[str, int] | None = None) -> DataFrame:
    """A table as it is: a row for each combination of keys (in order), a cell for every other column; numbers rounded as digits say."""
    names = [x for x in df.columns if x not in keys]
    text = lambda x: F.coalesce(F.format_string(f"%.{digits[x]}f", x) if digits and x in digits else F.col(x).cast("string"), F.lit(""))
    text_or_none = lambda x: F.when(F.col(x).isNotNull(), text(x)).otherwise("")
    row = F.concat_ws(" | ", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    each = F.array(*[F.struct(F.lit(x).alias("column"), text_or_none(x).alias("cell")) for x in names])
    return df.select(F.lit(panel).alias("panel"), F.lit(0).alias("place"), row.alias("row"), F.inline(each)).select(*CELLS)


def characteristics(df: DataFrame, panel: str, scope: str, shares: list[str], means: dict[str, int], weight: str) -> DataFrame:
    """Columns are ALL and the levels of scope: weighted percent (n) of every level of the share variables, weighted mean (SD)
    of the others with so many digits. A missing level is a row of its own; rows without a mean's value leave only that mean."""
    levels = F.explode(F.array(F.lit("ALL"), F.col(scope).cast("string")))
    rows = df.withColumn("column", levels).where("column is not null")
    variable = F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(v).alias("variable"), F.coalesce(F.col(v).cast("string"), F.lit("(missing)")).alias("level")) for i, v in enumerate(shares)]))
    counts = rows.select("column", F.col(weight).alias("w"), variable.alias("v")).groupBy("column", "v.place", "v.variable", "v.level").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"))
    totals = counts.groupBy(F.col("column").alias("c2"), F.col("variable").alias("v2")).agg(F.sum("w").alias("total"))
    shared = counts.join(totals, (F.col("column") == F.col("c2")) & (F.col("variable") == F.col("v2")))
    out = shared.select(F.lit(panel).alias("panel"), "place", F.concat_ws(": ", "variable", "level").alias("row"), "column", F.format_string("%.1f%% (n=%d)", 100 * F.col("w") / F.col("total"), "n").alias("cell"))
    known = lambda x, v: F.when(F.col(x).isNotNull(), v)
    for i, (x, digits) in enumerate(means.items()):
        w = F.sum(known(x, F.col(weight)))
        mean = F.sum(known(x, F.col(weight) * F.col(x))) / w
        first = rows.groupBy("column").agg(mean.alias("mean"))
        spread = rows.join(first.withColumnRenamed("column", "c2"), F.col("column") == F.col("c2")).groupBy("column", "mean").agg(F.sqrt(F.sum(known(x, F.col(weight) * (F.col(x) - F.col("mean")) * (F.col(x) - F.col("mean")))) / w).alias("sd"))
        cell = F.when(F.col("mean").isNotNull(), F.format_string(f"%.{digits}f (%.{digits}f)", "mean", "sd")).otherwise("")
        out = out.unionByName(spread.select(F.lit(panel).alias("panel"), F.lit(len(shares) + i).alias("place"), F.lit(x).alias("row"), "column", cell.alias("cell")))
    return out


def notes(df: DataFrame, panel: str, text: str) -> DataFrame:
    """A last row that holds a note; df gives the session only."""
    return df.sparkSession.range(1).select(F.lit(panel).alias("panel"), F.lit(1_000_000).alias("place"), F.lit(text).alias("row"), F.lit("").alias("column"), F.lit("").alias("cell"))


def wide(cells: DataFrame, columns: list[str]) -> DataFrame:
    """panel, place, row and one column each, in order; blank where a panel has no such cell."""
    out = cells.groupBy("panel", "place", "row").pivot("column", columns).agg(F.first("cell"))
    return out.na.fill("", subset=columns).orderBy("panel", "place", "row")
