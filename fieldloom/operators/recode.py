"""Recoding of raw coded measures with explicit missing-data states."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_match(rules: list[tuple[Column, object]], default=None) -> Column:
    """Ordered, mutually exclusive classes: the first rule that holds wins; a rule that is NULL does not hold."""
    out = F
    for condition, value in rules:
        out = out.when(condition, value)
    return out.otherwise(default)


def special_codes(raw: Column, codes: dict[int, str]) -> tuple[Column, Column, Column]:
    """(state, flag code, value / 100): missing, one state for each special code, or valid; only valid rows are scaled."""
    state = first_match([(raw.isNull(), "missing"), *[(raw == c, name) for c, name in codes.items()]], "valid")
    return state, F.when(raw.isin(*codes), raw.cast("int")), F.when(raw.isNotNull() & ~raw.isin(*codes), raw / 100)


def below(value: Column, cut: float) -> Column:
    """1 below the cut, 0 at or above it, NULL if missing."""
    return F.when(value.isNotNull(), (value < cut).cast("int"))


def code_map(code: Column, mapping: dict) -> Column:
    """A closed-world map; codes outside it become NULL, which unmapped() reports."""
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])[code]


def unmapped(df: DataFrame, column: str, mapping: dict) -> DataFrame:
    """Codes (and NULL) that a map does not hold, with their counts; must be empty."""
    return df.where(F.col(column).isNull() | ~F.col(column).isin(*mapping)).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def service_level(category: Column, shared: Column, structural: int = 7) -> Column:
    """Only Improved consults the sharing flag: 0 Basic, 1 Limited, the structural code not applicable; other states pass."""
    return F.when(category == "Improved", F.when(shared == 0, "Basic").when(shared == 1, "Limited").when(shared == structural, "StructuralNotApplicable")).otherwise(category)


def indicator(state: Column, positive: list, zero: list) -> tuple[Column, Column]:
    """(0/1/NULL, included): excluded states have neither value and do not count."""
    value = F.when(state.isin(*positive), 1).when(state.isin(*zero), 0)
    return value, value.isNotNull()


def complete(columns: list[str], weight: str | None = None) -> Column:
    """Whether all columns are present, and the weight positive."""
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    return known & (F.col(weight) > 0) if weight else known


def right_closed(value: Column, edges: list[float], labels: list[str]) -> Column:
    """Bins (e0, e1], (e1, e2], ...; NULL outside."""
    return reduce(lambda out, x: out.when((value > x[0]) & (value <= x[1]), x[2]), zip(edges, edges[1:], labels, strict=False), F).otherwise(None)


def dummies(df: DataFrame, column: str, levels: list, reference) -> DataFrame:
    """One 0/1 column for each level but the reference, which must be among them."""
    if reference not in levels:
        raise ValueError(f"{reference!r} is no level of {column}")
    return df.withColumns({f"{column}_{i}": (F.col(column) == x).cast("double") for i, x in enumerate(levels) if x != reference})


def value_class(x: Column) -> Column:
    """finite, nan, plus_inf, minus_inf or null."""
    return F.when(x.isNull(), "null").when(F.isnan(x), "nan").when(x == float("inf"), "plus_inf").when(x == float("-inf"), "minus_inf").otherwise("finite")


def agreement(difference: Column, exact: float = 1e-9, rounded: float = 5e-3) -> Column:
    return F.when(F.abs(difference) <= exact, "exact").when(F.abs(difference) <= rounded, "rounded").otherwise("discrepant")


def label_class(label: Column) -> Column:
    """Not in universe, missing, flagged or a substantive value, by the label's words."""
    has = lambda *words: reduce(lambda a, b: a | b, [F.lower(label).contains(w) for w in words])
    return F.when(has("niu", "not in universe"), "niu").when(has("missing", "unknown"), "missing").when(has("flag", "implausible"), "flag").otherwise("value")


def valid_coordinates(lat: Column, lon: Column, box: tuple[float, float, float, float] = (-90, 90, -180, 180)) -> Column:
    """ok, missing, sentinel (both zero), one_zero, outside the globe, or outside the box (south, north, west, east)."""
    south, north, west, east = box
    return first_match([
        (lat.isNull() | lon.isNull(), "missing"), ((lat == 0) & (lon == 0), "sentinel"), ((lat == 0) | (lon == 0), "one_zero"),
        (~(lat.between(-90, 90) & lon.between(-180, 180)), "out_of_range"), (~(lat.between(south, north) & lon.between(west, east)), "outside_box"),
    ], "ok")


def sign_change(a: Column, b: Column) -> Column:
    return F.signum(a) != F.signum(b)


def significance_change(p: Column, q: Column, level: float = 0.05) -> Column:
    return (p < level) != (q < level)
