"""Exact quantiles of large groups by distributed selection.

A quantile with linear interpolation needs two order statistics. Each is searched in an interval of values: a pass counts the
rows of its group in PARTS equal parts of the interval, with each part's smallest and largest value, and the part that holds the
rank becomes the interval. Passes read a narrow written table and return counts; no task holds a group's values. Once an
interval has one value, it is found; once it has few rows (SMALL), these are sorted.

Groups must be few, since their intervals are on the driver; they may be of any size. Missing and NaN values don't count;
infinite ones count as the largest finite numbers.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.sources.tables import stored

PARTS, SMALL = 256, 100_000
#: Groups times order statistics.
MOST_RANKS = 200_000
LARGEST = 1.7976931348623157e308


@dataclass
class Search:
    group: object
    rank: int
    low: float
    high: float
    below: int
    rows: int
    value: float | None = None


def _narrow(rows: DataFrame, searches: list[Search]) -> None:
    """One pass: each search goes on in the part of its interval that holds its rank."""
    intervals = sorted({(s.group, s.low, s.high) for s in searches}, key=str)
    place = {x: i for i, x in enumerate(intervals)}
    table = rows.sparkSession.createDataFrame([(g, i, low, high) for i, (g, low, high) in enumerate(intervals)], f"_k {rows.schema['_g'].dataType.simpleString()}, i int, low double, high double")
    half = lambda a, b: a / 2 - b / 2
    # the intervals of a group are disjoint or equal, so a row is in one at most
    met = rows.join(F.broadcast(table), rows["_g"].eqNullSafe(table["_k"]) & F.col("x").between(F.col("low"), F.col("high")))
    part = F.least(F.floor(half(F.col("x"), F.col("low")) / half(F.col("high"), F.col("low")) * PARTS), F.lit(PARTS - 1))
    counts: dict[int, list] = {}
    for i, p, n, low, high in met.groupBy("i", part.alias("part")).agg(F.count(F.lit(1)), F.min("x"), F.max("x")).collect():
        counts.setdefault(i, []).append((p, n, low, high))
    for s in searches:
        for _, n, low, high in sorted(counts[place[s.group, s.low, s.high]]):
            if s.below + n > s.rank:
                s.low, s.high, s.rows = low, high, n
                break
            s.below += n


def _sorted(rows: DataFrame, searches: list[Search]) -> None:
    """The values of searches whose intervals hold few rows."""
    intervals: dict[tuple, list[Search]] = {}
    for s in searches:
        intervals.setdefault((s.group, s.low, s.high), []).append(s)
    listed = list(intervals.items())
    table = rows.sparkSession.createDataFrame([(g, i, low, high, [s.rank - s.below for s in found]) for i, ((g, low, high), found) in enumerate(listed)], f"_k {rows.schema['_g'].dataType.simpleString()}, i int, low double, high double, at array<int>")
    met = rows.join(F.broadcast(table), rows["_g"].eqNullSafe(table["_k"]) & F.col("x").between(F.col("low"), F.col("high")))
    for i, values in met.groupBy("i", "at").agg(F.sort_array(F.collect_list("x")).alias("x")).select("i", F.transform("at", lambda k: F.get("x", k))).collect():
        for s, v in zip(listed[i][1], values, strict=True):
            s.value = v


def quantiles(df: DataFrame, column: str, qs: list[float], group: str | None = None) -> DataFrame:
    """Per group (one named "group" without one): n and q, the quantiles in order."""
    name, x = group or "group", F.nanvl(F.col(column).cast("double"), F.lit(None))
    rows = df.select((F.col(group) if group else F.lit("ALL")).alias("_g"), x.alias("x")).where("x is not null")
    rows = stored(rows.withColumn("x", F.greatest(F.least("x", F.lit(LARGEST)), F.lit(-LARGEST))), "quantile-values")
    searches: list[Search] = []
    found: dict[object, dict[int, Search]] = {}
    groups = rows.groupBy("_g").agg(F.count(F.lit(1)), F.min("x"), F.max("x")).limit(MOST_RANKS // (2 * len(qs)) + 1).collect()
    if len(groups) > MOST_RANKS // (2 * len(qs)):
        raise ValueError("too many groups")
    for g, n, low, high in groups:
        for q in qs:
            at = math.floor((n - 1) * q)
            for rank in (at, min(at + 1, n - 1)):
                if rank not in found.setdefault(g, {}):
                    found[g][rank] = Search(g, rank, low, high, 0, n)
                    searches.append(found[g][rank])
    while True:
        wide = [s for s in searches if s.low < s.high and s.rows > SMALL]
        if not wide:
            break
        _narrow(rows, wide)
    few = [s for s in searches if s.low < s.high]
    if few:
        _sorted(rows, few)
    out = []
    for g, n, *_ in groups:
        value = lambda rank: found[g][rank].value if found[g][rank].value is not None else found[g][rank].low  # noqa: E731, B023
        row = []
        for q in qs:
            h = (n - 1) * q
            low, high = value(math.floor(h)), value(min(math.floor(h) + 1, n - 1))
            row.append(low + (high - low) * (h - math.floor(h)))
        out.append((g, n, row))
    return df.sparkSession.createDataFrame(out, f"`{name}` {rows.schema['_g'].dataType.simpleString()}, n long, q array<double>")
