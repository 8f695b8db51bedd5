"""Comparison of two result tables, row by row and column by column."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.sources.tables import stored


def value_class(x: Column) -> Column:
    """missing, nan, +inf, -inf or finite."""
    return F.when(x.isNull(), "missing").when(F.isnan(x), "nan").when(x == float("inf"), "+inf").when(x == float("-inf"), "-inf").otherwise("finite")


def compare_runs(a: DataFrame, b: DataFrame, key: str, columns: list[str], tolerance: float = 1e-9) -> DataFrame:
    """column, outcome, n: rows only in one run, repeated keys, and for the others whether both values are of one class and agree."""
    sides = [d.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias(f"_rows_{s}"), *[F.first(x).cast("double").alias(f"{x}_{s}") for x in columns]) for d, s in ((a, "a"), (b, "b"))]
    both = sides[0].join(sides[1], "_key", "full_outer")

    def outcome(x: str) -> Column:
        u, v = F.col(f"{x}_a"), F.col(f"{x}_b")
        return (
            F.when(F.col("_rows_b").isNull(), "only_a").when(F.col("_rows_a").isNull(), "only_b").when((F.col("_rows_a") > 1) | (F.col("_rows_b") > 1), "repeated_key")
            .when(value_class(u) != value_class(v), F.concat_ws(" to ", value_class(u), value_class(v)))
            .when((value_class(u) != "finite") | (F.abs(u - v) <= tolerance), "same").otherwise("differs")
        )

    each = F.array(*[F.struct(F.lit(x).alias("column"), outcome(x).alias("outcome")) for x in columns])
    return both.select(F.inline(each)).groupBy("column", "outcome").agg(F.count(F.lit(1)).alias("n"))


def _number(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


@dataclass
class Report:
    """counts: section, item, outcome, n, largest (gap of two finite numbers). listed: section, key, item: every key that is
    missing, repeated or differs. reasons: why the runs are not the same (empty: they are)."""

    counts: DataFrame
    listed: DataFrame | None
    reasons: list[str]


def report(a: DataFrame, b: DataFrame, key: str, required: list[str] = (), tolerance: float = 1e-9) -> Report:
    """Two runs of one result, compared as their schemas say: columns of either, keys, and every common column by its type.

    Without a required column (the key is one) nothing else is compared. Numbers agree within the tolerance if both are
    finite, else by class (missing, nan, +inf, -inf); everything else agrees if its text does. Keys that repeat on a side are
    named, and their rows are not compared. A null key is a key.
    """
    spark = a.sparkSession
    kinds = [{f.name: f.dataType for f in d.schema.fields} for d in (a, b)]
    columns = [("columns", x, "only_a" if x in kinds[0] else "only_b", 1, None) for x in sorted(set(kinds[0]) ^ set(kinds[1]))]
    missing = [x for x in dict.fromkeys([key, *required]) if x not in kinds[0] or x not in kinds[1]]
    common = [x for x in kinds[0] if x in kinds[1] and x != key]
    unlike = [x for x in common if _number(kinds[0][x]) != _number(kinds[1][x])]
    columns += [("columns", x, "other_type", 1, None) for x in unlike]
    schema = "section string, item string, outcome string, n long, largest double"
    if missing:
        return Report(spark.createDataFrame(columns + [("columns", x, "required_missing", 1, None) for x in missing], schema), None, ["missing_required_columns"])
    common = [x for x in common if x not in unlike]
    sides = []
    for d, s in ((a, "a"), (b, "b")):
        value = lambda x: F.col(x).cast("double" if _number(kinds[0][x]) else "string")
        sides.append(d.groupBy(F.col(key).cast("string").alias(f"_key_{s}")).agg(F.count(F.lit(1)).alias(f"_n_{s}"), *[F.first(value(x)).alias(f"{i}_{s}") for i, x in enumerate(common)]))
    both = stored(sides[0].join(sides[1], F.col("_key_a").eqNullSafe(F.col("_key_b")), "full_outer"), "run-comparison")
    absent = F.when(F.col("_n_b").isNull(), "only_a").when(F.col("_n_a").isNull(), "only_b")
    repeated = F.when((F.col("_n_a") > 1) & (F.col("_n_b") > 1), "repeated_in_both").when(F.col("_n_a") > 1, "repeated_in_a").when(F.col("_n_b") > 1, "repeated_in_b")

    def outcome(i: int, x: str) -> tuple[Column, Column]:
        u, v = F.col(f"{i}_a"), F.col(f"{i}_b")
        if not _number(kinds[0][x]):
            return F.when(u.eqNullSafe(v), "same").when(u.isNull(), "missing to text").when(v.isNull(), "text to missing").otherwise("differs"), F.lit(None).cast("double")
        finite = (value_class(u) == "finite") & (value_class(v) == "finite")
        kind = F.when(value_class(u) != value_class(v), F.concat_ws(" to ", value_class(u), value_class(v))).when(~finite | (F.abs(u - v) <= tolerance), "same").otherwise("differs")
        return kind, F.when(finite, F.abs(u - v))

    keys = F.array(*[F.struct(F.lit("keys").alias("section"), F.lit(None).cast("string").alias("item"), o.alias("outcome"), F.lit(None).cast("double").alias("gap")) for o in (absent, repeated)])
    paired = absent.isNull() & repeated.isNull()
    parts = [F.struct(F.lit("values").alias("section"), F.lit(x).alias("item"), F.when(paired, o).alias("outcome"), gap.alias("gap")) for i, x in enumerate(common) for o, gap in [outcome(i, x)]]
    each = both.select(F.coalesce("_key_a", "_key_b").alias("key"), F.inline(F.concat(keys, F.array(*parts)) if parts else keys)).where("outcome is not null")
    sums = each.groupBy("section", "item", "outcome").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("largest"))
    rows = stored(sums, "run-outcomes")
    reasons = ["unequal_columns"] * any(o.startswith("only") for _, _, o, *_ in columns) + ["other_types"] * bool(unlike)
    seen = {(r.section, r.outcome, r.numeric) for r in rows.select("section", "outcome", F.col("item").isin([x for x in common if _number(kinds[0][x])]).alias("numeric")).distinct().collect()}
    reasons += ["repeated_keys"] * any(s == "keys" and o.startswith("repeated") for s, o, _ in seen) + ["missing_or_extra_keys"] * any(s == "keys" and o.startswith("only") for s, o, _ in seen)
    reasons += ["numbers_differ"] * any(s == "values" and o != "same" and n for s, o, n in seen) + ["texts_differ"] * any(s == "values" and o != "same" and not n for s, o, n in seen)
    return Report(rows.unionByName(spark.createDataFrame(columns, schema)), each.where("outcome <> 'same'").select("section", "key", "item", "outcome"), reasons)
