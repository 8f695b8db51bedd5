"""Exposure windows: months before or after an event, spread over calendar years, met with an annual panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions import calendar as C

from .recode import first_match

#: window: (kind, months). A birth window is the calendar year of the event, pre ends before it, post starts with it.
WINDOWS = {"birth_year": ("birth", 12), "prenatal": ("pre", 9), "post_12": ("post", 12), "post_24": ("post", 24)}
#: Month indices (January 1900 is 1) outside this range are no dates.
MONTHS = (1000, 1800)


def window_rows(df: DataFrame, event: str) -> DataFrame:
    """One row per unit and window: window, kind, months, start (a month index; NULL without an event)."""
    b = F.col(event)
    start = {"birth": C.month_index(C.year_of(b), F.lit(1)), "pre": b - 9, "post": b}
    return df.select("*", F.inline(F.array(*[F.struct(F.lit(w).alias("window"), F.lit(kind).alias("kind"), F.lit(m).alias("months"), start[kind].cast("long").alias("start")) for w, (kind, m) in WINDOWS.items()])))


def window_years(rows: DataFrame) -> DataFrame:
    """Fans windows out to the calendar years that they touch: year, weight (the share of the window's months)."""
    last = F.col("start") + F.col("months") - 1
    years = rows.where(F.col("start").isNotNull()).withColumn("year", F.explode(F.sequence(C.year_of(F.col("start")), C.year_of(last))))
    return years.withColumn("weight", C.overlap_months(F.col("start"), F.col("months"), F.col("year")) / F.col("months"))


def by_cluster(panel: DataFrame, products: list[str], years: tuple[int, int], cluster: str) -> DataFrame:
    """A panel of rows (cluster, product, year, value, state, valid_fraction) as one row a cluster: the arrays values, full and
    valid_fractions, product by product, with an entry a year of years."""
    span = years[1] - years[0] + 1
    place = F.array_position(F.array(*map(F.lit, products)), F.col("product")) - 1
    at = (place * span + F.col("year") - years[0]).cast("int")
    entry = F.struct(F.col("value").cast("double").alias("values"), F.coalesce(F.col("state") == "full", F.lit(False)).alias("full"), F.col("valid_fraction").cast("double").alias("valid_fractions"))
    known = panel.where(F.col("product").isin(*products) & F.col("year").between(*years))
    rows = known.groupBy(cluster).agg(F.map_from_entries(F.collect_list(F.struct(at.alias("at"), entry.alias("entry")))).alias("_held"))
    each = lambda name: F.transform(F.sequence(F.lit(0), F.lit(len(products) * span - 1)), lambda i: F.element_at("_held", i)[name])
    return rows.select(cluster, *[each(name).alias(name) for name in ("values", "full", "valid_fractions")])


def met_windows(units: DataFrame, panel: DataFrame, products: list[str], years: tuple[int, int], cluster: str, event: str) -> DataFrame:
    """The columns of units by window and product, with window, kind, months, start, product, exposure, min_valid_fraction and
    n_years, and for window_status _first and _last (the years that the window touches), _missing and _full.

    A cluster's panel is one row of arrays (by_cluster), so a unit moves once, to its cluster, before it fans out; its windows
    are arithmetic on the arrays. The panel grows with the clusters and is never broadcast.
    """
    span = years[1] - years[0] + 1
    arrays = panel.select(cluster, *[F.col(x).alias(f"_{x}") for x in ("values", "full", "valid_fractions")])
    rows = window_rows(units.join(arrays.hint("merge"), cluster, "left"), event)
    rows = rows.select("*", F.posexplode(F.array(*[F.lit(p) for p in products])).alias("_p", "product"))
    first, last = C.year_of(F.col("start")), C.year_of(F.col("start") + F.col("months") - 1)
    whole, full, total, fractions = F.lit(True), F.lit(True), F.lit(0.0), []
    for k in range(max((months + 10) // 12 + 1 for _, months in WINDOWS.values())):
        year = first + k
        touched = year <= last
        at = F.when(touched & year.between(*years), (F.col("_p") * span + year - years[0]).cast("int"))
        value = F.get("_values", at)
        whole = whole & (~touched | value.isNotNull())
        full = full & (~touched | F.coalesce(F.get("_full", at), F.lit(False)))
        total = total + F.coalesce(C.overlap_months(F.col("start"), F.col("months"), year) / F.col("months") * value, F.lit(0.0))
        fractions.append(F.when(touched, F.coalesce(F.get("_valid_fractions", at), F.lit(0.0))))
    return rows.select(
        *units.columns, "window", "kind", "months", "start", "product", F.when(whole, total).alias("exposure"), F.least(*fractions).alias("min_valid_fraction"), (last - first + 1).cast("long").alias("n_years"),
        first.alias("_first"), last.alias("_last"), (~whole).alias("_missing"), full.alias("_full"),
    )


def window_status(cluster: Column, event: Column, interview: Column, years: tuple[int, int], excluded: Column | None = None) -> Column:
    """The first rule that holds for a row of met_windows."""
    dated = F.coalesce(event.between(*MONTHS) & interview.between(*MONTHS), F.lit(False))
    return first_match([
        (cluster.isNull(), "unmatched_cluster"), (F.lit(False) if excluded is None else excluded, "not_applicable"), (~dated, "dates_missing"), (event > interview, "birth_after_interview"),
        ((F.col("_first") < years[0]) | (F.col("_last") > years[1]), "window_outside_years"), ((F.col("kind") == "post") & (interview < event + F.col("months")), "postnatal_incomplete"),
        (F.col("_missing"), "spatial_missing_year"), (~F.col("_full"), "spatial_partial_year"),
    ], "eligible_complete")


def exposures(units: DataFrame, panel: DataFrame, products: list[str], years: tuple[int, int], key: str, cluster: str, event: str, interview: str, excluded: Column | None = None, keep: list[str] = ()) -> DataFrame:
    """key, product, window, status, exposure, min_valid_fraction, n_years, interview_year_used, and the unit's columns in keep.

    panel has rows (cluster, product, year, value, state, valid_fraction), where state is full, partial or missing, one a cluster,
    product and year, or is by_cluster's table. The first rule that holds gives the status; a missing year is never filled, so
    exposure is NULL unless every year has a value; years outside of years have none.
    """
    arrays = panel if "values" in panel.columns else by_cluster(panel, products, years, cluster)
    listed = units.select(*dict.fromkeys([key, cluster, event, interview, *keep]), (F.lit(False) if excluded is None else excluded).alias("_excluded"))
    rows = met_windows(listed, arrays, products, years, cluster, event)
    t = F.col(interview)
    used = F.when(F.col("start").isNotNull(), F.coalesce(C.year_of(t).between(F.col("_first"), F.col("_last")), F.lit(False)))
    status = window_status(F.col(cluster), F.col(event), t, years, F.col("_excluded"))
    return rows.select(*dict.fromkeys([key, "product", "window"]), status.alias("status"), "exposure", "min_valid_fraction", "n_years", used.alias("interview_year_used"), *keep)
