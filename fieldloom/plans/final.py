"""The final tables and the appendix as stacked cells, and the checks before them: G47, R6, Q13."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.operators import aggregates as A
from fieldloom.operators import final_tables as T
from fieldloom.operators import integrity as I
from fieldloom.operators import joins as J
from fieldloom.operators import survey as S
from fieldloom.sources.tables import stored

from . import grids
from .base import HOUSEHOLDS, n_rows, query

c = F.col
TERMS = {"community": "Community rate", "community_broad": "Community rate, broad"}
INFO = {"Price controls": grids.CONTROLS, "Time and band controls": ["years", "band_b", "band_c"], "Region effects": grids.EFFECTS}
NOTE = "Notes: associations, not effects. Exposures are rates among a cluster's other households, 0 to 1. Errors are clustered."


def stack(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def households(t) -> DataFrame:
    return t.households.select("n_regionkey", "o_custkey", "c_nationkey", "o_orderstatus", "o_orderpriority", "c_acctbal", "o_totalprice", (c("o_totalprice") / 1000).alias("w"))


@query(
    f"""with h as (select *, o_totalprice / 1000 w from {HOUSEHOLDS}), s as (select 'ALL' AS "column", * from h union all select n_regionkey::VARCHAR, * from h),
    v as (select "column", w, unnest(['o_orderstatus', 'o_orderpriority']) variable, unnest([o_orderstatus, o_orderpriority]) level, unnest([0, 1]) place from s),
    t as (select "column", place, variable, level, count(*) n, sum(w) w from v group by all),
    m as (select "column", unnest(['c_acctbal', 'o_totalprice']) AS "row", unnest([2, 3]) place, w, unnest([c_acctbal, o_totalprice]) x, unnest([2, 1]) d from s),
    a as (select "column", "row", place, d, sum(w * x) / sum(w) mean, sum(w) total from m group by all),
    k as (select n_regionkey, o_orderpriority, count(*) n, sum(w) w, count(*) filter (o_orderstatus <> 'P') known, count(distinct o_custkey) clusters from h group by 1, 2)
    select 'table 1' panel, place, variable || ': ' || level AS "row", "column", printf('%.1f%% (n=%d)', 100 * w / sum(w) over (partition by "column", variable), n) cell from t
    union all select 'table 1', place, "row", "column", printf('%.' || d || 'f (%.' || d || 'f)', mean, sqrt(sum(w * (x - mean) * (x - mean)) / total)) from m join a using ("column", "row", place, d) group by "column", "row", place, d, mean, total
    union all select 'table 3', 0, n_regionkey || ' | ' || o_orderpriority, unnest(['n', 'share']), unnest([n::VARCHAR, printf('%.1f', 100 * w / sum(w) over (partition by n_regionkey))]) from k
    union all select 'A7 availability', 0, n_regionkey || ' | ' || o_orderpriority, unnest(['n', 'known', 'percent']), unnest([n::VARCHAR, known::VARCHAR, printf('%.2f', 100 * known / n)]) from k
    union all select 'A8 regions', 0, n_regionkey::VARCHAR, unnest(['n', 'clusters']), unnest([count(*)::VARCHAR, count(distinct o_custkey)::VARCHAR]) from h group by n_regionkey
    union all select 'A8 support', 0, n_regionkey::VARCHAR, unnest(['least', 'most', 'mean']), unnest([min(z)::VARCHAR, max(z)::VARCHAR, printf('%.3f', avg(z))]) from (select n_regionkey, count(*) over (partition by o_custkey) - 1 z from h) group by n_regionkey"""
)
def g47_descriptive_tables(t):
    """Tables 1 and 3 and the appendix on availability and support, in one column of panels."""
    rows = households(t)
    shares = A.weighted_shares(rows, "o_orderpriority", c("w"), ["n_regionkey"])
    known = rows.groupBy("n_regionkey", "o_orderpriority").agg(n_rows(), F.count_if(c("o_orderstatus") != "P").alias("known")).withColumn("percent", 100 * c("known") / c("n"))
    support = J.leave_one_out(t.households, "o_custkey", F.lit(1)).groupBy("n_regionkey").agg(F.min("others_n").alias("least"), F.max("others_n").alias("most"), F.avg("others_n").alias("mean"))
    return stack([
        T.characteristics(rows, "table 1", "n_regionkey", ["o_orderstatus", "o_orderpriority"], {"c_acctbal": 2, "o_totalprice": 1}, "w"), T.records_panel(shares, "table 3", ["n_regionkey", "o_orderpriority"], {"share": 1}),
        T.records_panel(known, "A7 availability", ["n_regionkey", "o_orderpriority"], {"percent": 2}), T.records_panel(rows.groupBy("n_regionkey").agg(n_rows(), F.countDistinct("o_custkey").alias("clusters")), "A8 regions", ["n_regionkey"]),
        T.records_panel(support, "A8 support", ["n_regionkey"], {"mean": 3}),
    ])


def outcome_panels(results: DataFrame, table: str, outcomes: list[str], column: str, terms: dict[str, str], info: dict | None, style: str, sizes: bool) -> list[DataFrame]:
    return [T.models_panel(results.where(c("outcome") == y), f"{table} {y}", column, terms, info, style, 3, sizes) for y in outcomes]


@query()
def g47_model_tables(t):
    """Tables 2 and 4 to 6: prevalence, main models, the preferred one and the binary ones by scope; with information rows, sizes and notes."""
    yes = {"fulfilled": c("o_orderstatus") == "F", "expensive": c("o_totalprice") > 150000}
    prevalence = stack([S.design_proportion(households(t), v.cast("int"), "w", "c_nationkey", "o_custkey", ["n_regionkey"]).withColumn("outcome", F.lit(k)) for k, v in yes.items()])
    interval = F.format_string("[%.1f, %.1f]", 100 * c("low"), 100 * c("high")).alias("interval")
    prevalence = prevalence.select("n_regionkey", "outcome", "n", (100 * c("mean")).alias("percent"), interval)
    both = grids.families(t, {"main": grids.main_family(), "binary": grids.binary_family()})
    grid = both["main"].withColumns({"outcome": F.split("model", "/")[0], "design": F.split("model", "/")[1]})
    binary = both["binary"].withColumn("outcome", c("model"))
    parts = [T.records_panel(prevalence, "table 2", ["n_regionkey", "outcome"], {"percent": 1})]
    parts += outcome_panels(grid.where("scope = 'ALL'"), "table 4", grids.OUTCOMES, "design", TERMS, INFO, "se", True)
    parts += outcome_panels(grid.where("design = '4'"), "table 5", grids.OUTCOMES, "scope", TERMS, None, "ci", False)
    parts += outcome_panels(binary, "table 6", ["low", "middle", "severe"], "scope", {"community": TERMS["community"]}, None, "ci", False)
    return stack([*parts, *[T.notes(grid, f"table {i}", NOTE) for i in (4, 5, 6)]])


@query()
def r6_full_appendix(t):
    """Severe outcomes, the broader exposure beside the main one, households, weights, support, and every binary term."""
    rounded = {"beta": 4, "se": 4, "low": 4, "high": 4, "p": 3}
    pick = lambda df, terms, *more: df.where(c("term").isin(*terms)).select("scope", "model", "term", *more)
    numbers = ["beta", "se", "low", "high", "p"]
    severe = grids.g13_severe_family(t)
    variants = grids.g14_exposure_variants(t).where(c("term").isin(*TERMS))
    sides = {x: variants.where(c("term") == x).select(F.substring_index("model", "_", 1).alias("outcome"), *[c(v).alias(f"{v}_{x}") for v in ("beta", "se", "p")]) for x in TERMS}
    merged = sides["community"].join(sides["community_broad"], "outcome", "full_outer")
    baseline = grids.g15_household_baseline(t)
    excluded = baseline.crossJoin(F.broadcast(t.lineitem.agg(F.count(F.lit(1)).alias("all_units")))).withColumn("n_excluded", c("all_units") - c("n"))  # one row
    schemes = F.create_map(*[F.lit(x) for x in ("A", "A: equal region totals", "B", "B: stated weight", "C", "C: none")])
    binary = grids.g12_binary_family(t)
    warning = severe.orderBy(F.desc("regions_without"), "model").select("model", "regions_without", "regions").first()
    flag = f"WARNING: {warning[0]} has {warning[1]}/{warning[2]} regions without an event; read it as exploratory." if warning and warning[1] else "No region is without an event."
    return stack([
        T.records_panel(pick(severe, ["community"], *numbers, "events", "prevalence", "regions_without", "regions"), "A1 severe outcomes", ["model", "term"], rounded), T.notes(binary, "A1 severe outcomes", flag),
        T.records_panel(merged, "A2 broader exposure", ["outcome"], {f"{v}_{x}": d for x in TERMS for v, d in (("beta", 4), ("se", 4), ("p", 3))}),
        T.records_panel(pick(excluded, ["household"], *numbers, "n", "n_excluded"), "A3 households", ["model", "term"], rounded),
        T.records_panel(pick(grids.g16_weight_variants(t), ["community"], "beta", "se", "p").withColumn("scope", schemes[c("scope")]), "A4 weights", ["model", "scope", "term"], rounded),
        T.records_panel(pick(grids.g17_support_sensitivity(t), ["community"], "beta", "se", "p", "retained_n", "retained_percent"), "A5 support", ["model", "scope", "term"], rounded | {"retained_percent": 2}),
        T.records_panel(binary.where("term is not null").select("scope", "model", "term", *numbers, "n", "clusters"), "A6 binary models", ["model", "scope", "term"], rounded),
    ])


@query()
def q13_all_checks(t):
    """24 checks of the stored results before the final tables: shapes, keys, missing numbers, sample sizes, equal fits, metadata, scopes."""
    units = grids.written_units(t)
    families = {k: stored(v, f"results-{k}") for k, v in grids.all_families(t, units).items()}
    regions = t.households.select("n_regionkey").distinct().count()
    outcomes, designs, singles = len(grids.OUTCOMES), len(grids.DESIGNS), len(grids.SEVERE)
    estimated = lambda k, *more: families[k].where("term = 'community'").select("scope", "model", "beta", *more)
    expected = {"main": outcomes * designs * (regions + 1), "binary": 3 * (regions + 1), "severe": singles, "weights": 3 * outcomes, "support": 3 * outcomes}
    checks = [I.shape(k, estimated(k), n, 3) for k, n in expected.items()]
    checks += [f(k, v) for f in (I.no_duplicates, I.no_missing) for k, v in families.items()]
    stated, all_units = (families[k].where((c("scope") == s) & (c("term") == "community")) for k, s in (("weights", "B"), ("support", "support_1")))
    checks += [
        I.same_sizes("main", families["main"], grids.sample_sizes(units), ["scope", "model"]), I.equal_estimates("weights_and_support", stated, all_units, ["model", "term"]),
        I.equal_estimates("binary_and_support", families["binary"].where("scope = 'ALL' and model = 'low' and term = 'community'"), all_units, ["model", "term"]),
        I.one_value("severe_sparsity", families["severe"].where("model = 'severe'"), "regions_without"), I.only_scopes("severe", families["severe"], ["ALL"]),
    ]
    return I.audit(checks)
