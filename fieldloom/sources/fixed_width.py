"""Fixed-width text: raw and typed layers driven by a layout (variable, start, end, type), and layout checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Layout = list[tuple[str, int, int, str]]


def raw_layer(lines: DataFrame, layout: Layout, line: str = "value") -> DataFrame:
    """Every field as the untrimmed string that it has in the record; other columns pass by."""
    others = [c for c in lines.columns if c != line]
    return lines.select(*others, *[F.substring(line, start, end - start + 1).alias(name) for name, start, end, _ in layout])


def typed_layer(raw: DataFrame, layout: Layout) -> DataFrame:
    """Fields trimmed, blank as NULL, cast to their type; what does not cast is NULL too."""
    others = [c for c in raw.columns if c not in {x[0] for x in layout}]
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return raw.select(*others, *[(blank(F.col(n)) if kind == "string" else blank(F.col(n)).try_cast(kind)).alias(n) for n, _, _, kind in layout])


def cast_failures(raw: DataFrame, layout: Layout) -> DataFrame:
    """variable, n_failed: non-blank values that do not cast."""
    counts = [F.count_if((F.trim(n) != "") & F.trim(n).try_cast(kind).isNull()).alias(n) for n, _, _, kind in layout if kind != "string"]
    row = raw.agg(*counts)
    return row.unpivot([], row.columns, "variable", "n_failed")


def to_lines(df: DataFrame, layout: Layout) -> DataFrame:
    """Records of fixed width from typed columns (each right-aligned, NULL blank): the inverse of typed_layer."""
    return df.select(F.concat(*[F.lpad(F.coalesce(F.col(n).cast("string"), F.lit("")), end - start + 1, " ") for n, start, end, _ in layout]).alias("value"))


def line_lengths(lines: DataFrame, line: str = "value") -> DataFrame:
    """length, n_lines, n_non_ascii: more than one row means damaged records."""
    return lines.groupBy(F.length(line).alias("length")).agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(F.col(line).rlike(r"[^\x00-\x7F]")).alias("n_non_ascii"))


def reconcile(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two layout tables (variable, start, end, type, codes) by lower-cased name: what differs."""
    key = F.lower("variable").alias("variable")
    left, right = (d.select(key, F.struct("start", "end").alias(f"span_{s}"), F.col("type").alias(f"type_{s}"), F.col("codes").alias(f"codes_{s}")) for d, s in ((a, "a"), (b, "b")))
    same = lambda x: F.col(f"{x}_a").eqNullSafe(F.col(f"{x}_b"))
    extra = lambda x, y: F.size(F.array_except(F.coalesce(f"codes_{x}", F.array().cast("array<string>")), F.coalesce(f"codes_{y}", F.array().cast("array<string>"))))
    side = F.when(F.col("span_a").isNull(), "only_b").when(F.col("span_b").isNull(), "only_a").otherwise("both")
    return left.join(right, "variable", "full_outer").select("variable", side.alias("side"), same("span").alias("same_span"), same("type").alias("same_type"), extra("a", "b").alias("codes_only_a"), extra("b", "a").alias("codes_only_b"))


def gaps(layout: DataFrame) -> DataFrame:
    """variable, start, end, gap: columns between the field and the one before it (negative: overlap). A layout is a few hundred rows, so one task orders it."""
    before = F.lag("end").over(Window.orderBy("start", "end"))
    return layout.select("variable", "start", "end", (F.col("start") - before - 1).alias("gap")).where(F.col("gap") != 0)
