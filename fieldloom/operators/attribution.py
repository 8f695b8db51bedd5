"""Why units are excluded: ordered rules, counts that sum to all records, and candidates that disagree.

Both reports are aggregates of expressions; rows move only as partial counts, or once by unit to bring its candidates together
where these come in rows of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .recode import first_match

INCLUDED = "included"


def exclusion_flow(df: DataFrame, by: list[str], rules: dict[str, Column], outcomes: dict[str, dict[str, Column]] | None = None, place: int = 0, n: str | None = None) -> DataFrame:
    """by, (outcome,) category, n: each record counts once, in the first rule that holds, or as included. Null is no match.

    outcomes: rules of each outcome, put in at place among the others; every record then counts once for each outcome, and is
    counted by its categories under all of them before it fans out. n: a column of counts, if a row stands for several records.
    """
    pairs = lambda named: [(condition, name) for name, condition in named.items()]
    listed, number = pairs(rules), (F.count(F.lit(1)) if n is None else F.sum(n)).alias("n")
    if outcomes is None:
        return df.groupBy(*by, first_match(listed, INCLUDED).alias("category")).agg(number)
    own = [first_match([*listed[:place], *pairs(more), *listed[place:]], INCLUDED).alias(f"_category_{i}") for i, more in enumerate(outcomes.values())]
    counted = df.groupBy(*by, *own).agg(number)
    each = F.array(*[F.struct(F.lit(o).alias("outcome"), F.col(f"_category_{i}").alias("category")) for i, o in enumerate(outcomes)])
    return counted.select(*by, F.inline(each), "n").groupBy(*by, "outcome", "category").agg(F.sum("n").alias("n"))


def reconciles(flow: DataFrame, records: DataFrame, by: list[str]) -> DataFrame:
    """by, outcome, n, records, equal: whether a flow's categories sum to the records (by, records)."""
    sums = flow.groupBy(*by, "outcome").agg(F.sum("n").alias("n"))
    return sums.join(records, by, "left").withColumn("equal", F.col("n").eqNullSafe(F.col("records")))


def _places(status: Column, order: list[str]) -> Column:
    """The place of a status in order, from 1; one of no place comes after them."""
    place = F.array_position(F.array(*map(F.lit, order)), status)
    return F.when(place > 0, place).otherwise(len(order) + 1)


def _patterns(wide: DataFrame, candidates: list[str], order: list[str], by: list[str], number: Column) -> DataFrame:
    """The patterns of a table with a column of places a candidate, null where it has none."""
    name = lambda p: F.coalesce(F.get(F.array(*map(F.lit, [*order, "other"])), p - 1), F.lit("absent"))
    absent = lambda x: F.coalesce(F.col(x), F.lit(len(order) + 2))
    differ = F.size(F.array_distinct(F.array(*[absent(x) for x in candidates]))) > 1
    first = F.array_min(F.array(*[absent(x) for x in candidates])) if len(candidates) > 1 else absent(candidates[0])
    decided = F.when(first > len(order) + 1, F.lit("absent")).otherwise(name(first))
    return wide.where(differ).groupBy(*by, *[name(F.col(x)).alias(x) for x in candidates], decided.alias("decided_by")).agg(number.alias("n"))


def candidate_patterns(df: DataFrame, unit: list[str], candidate: str, status: str, candidates: list[str], order: list[str], by: list[str] = ()) -> DataFrame:
    """by, a column of statuses a candidate, decided_by, n: units whose status differs between candidates, by pattern.

    decided_by is the first rule in order that excludes the unit under any candidate (a missing row counts as absent, last).
    Units have one row a candidate; of several, the first status in order stands.
    """
    ranked = df.select(*dict.fromkeys([*by, *unit]), F.col(candidate).alias("_c"), _places(F.col(status), order).alias("_p"))
    wide = ranked.groupBy(*dict.fromkeys([*by, *unit])).agg(*[F.min(F.when(F.col("_c") == x, F.col("_p"))).alias(x) for x in candidates])
    return _patterns(wide, candidates, order, list(by), F.count(F.lit(1)))


def status_patterns(df: DataFrame, candidates: list[str], order: list[str], by: list[str] = (), n: str | None = None) -> DataFrame:
    """candidate_patterns of units that have their statuses in one row, a column a candidate (null where it is absent): nothing
    moves but counts. n: a column of counts, if a row stands for several units."""
    wide = df.select(*by, *[F.when(F.col(x).isNotNull(), _places(F.col(x), order)).alias(x) for x in candidates], (F.lit(1) if n is None else F.col(n)).alias("_n"))
    return _patterns(wide, candidates, order, list(by), F.sum("_n"))
