"""Queries of model families, each fitted by two passes over the units: G10 to G17, G19, G21 to G27, G40, G43, E18, E20, E21, R4, R5.

Units are line items; the community exposure is the share of fulfilled orders among the other orders of the customer, the
household exposure the order's own status; regions are fixed effects. Results are rows (scope, model, term, ...).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions import smallmath as M
from fieldloom.operators import aggregates as A
from fieldloom.operators import joins as J
from fieldloom.operators import regress as G
from fieldloom.operators import weights as W
from fieldloom.sources.tables import stored

from .base import HOUSEHOLDS, n_rows, query

c = F.col
RESULT = "scope string, model string, status string, term string, beta double, se double, p double, low double, high double, n long, clusters long, k int"
REGIONS = 5
EFFECTS = [f"region_{i}" for i in range(1, REGIONS)]
CONTROLS = ["l_discount", "l_tax"]


def units(t) -> DataFrame:
    value = F.when(c("o_orderstatus") == "F", 1).when(c("o_orderstatus") == "O", 0)
    broad = (c("o_orderstatus") != "O").cast("int")
    # sums by customer meet the units after these are dealt by customer, so a unit moves twice, with few columns, and what
    # follows by customer moves nothing
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus")
    sums = orders.groupBy("o_custkey").agg(*[f(v).alias(f"_{f.__name__}_{k}") for k, v in (("v", value), ("b", broad)) for f in (F.sum, F.count)])
    customers = t.customer.join(F.broadcast(t.nation), c("c_nationkey") == c("n_nationkey")).select("c_custkey", "n_regionkey")
    customers = sums.join(customers, c("o_custkey") == c("c_custkey")).drop("o_custkey")
    rows = t.lineitem.join(orders, c("l_orderkey") == c("o_orderkey")).join(customers.hint("shuffle_hash"), c("o_custkey") == c("c_custkey"))
    support, community = J.others(value, c("_sum_v"), c("_count_v"))
    rows = rows.withColumns({"support": support, "community": community, "community_broad": J.others(broad, c("_sum_b"), c("_count_b"))[1]})
    return rows.select(
        "l_orderkey", "o_custkey", "n_regionkey", "support", "community", "community_broad", value.cast("double").alias("household"), "l_discount", "l_tax", c("l_quantity").alias("weight"),
        (c("l_extendedprice") / 10000).alias("y1"), (c("l_extendedprice") / c("l_quantity") / 1000).alias("y2"), (c("l_extendedprice") < 30000).cast("double").alias("low"), (c("l_extendedprice") < 5000).cast("double").alias("severe"),
        (c("l_extendedprice") < 15000).cast("double").alias("middle"), (c("l_extendedprice") / c("l_quantity") < 1100).cast("double").alias("severe_unit"), ((c("l_extendedprice") < 5000) & (c("l_quantity") < 3)).cast("double").alias("severe_both"),
        F.when(c("l_quantity") <= 10, "a").when(c("l_quantity") <= 30, "b").otherwise("c").alias("band"), F.year("l_shipdate").alias("year"),
        *[(c("n_regionkey") == i).cast("double").alias(f"region_{i}") for i in range(1, REGIONS)],
    )


def table(t, fits: dict[tuple[str, str], G.Fit]) -> DataFrame:
    """One row per term, and one without a term for each refused model."""
    rows = []
    for (scope, model), f in sorted(fits.items()):
        rows += [(scope, model, f.status, term, *(round(v, 7) for v in numbers), f.n, f.clusters, f.k) for term, *numbers in f.rows()] or [(scope, model, f.status, None, None, None, None, None, None, f.n, f.clusters, f.k)]
    return t.spark.createDataFrame(rows, RESULT)


def fitted(t, df: DataFrame, specs: dict, scope: str | None = "n_regionkey", effects: list[str] = EFFECTS) -> DataFrame:
    return table(t, G.fit_grid(df, specs, "weight", "o_custkey", scope, effects))


#: The main grid: every design holds the exposures and adds a block to the one before; the last one adds the fixed effects.
OUTCOMES, EXPOSURES = ["y1", "y2", "low"], ["community", "community_broad"]
DESIGNS = {"1": EXPOSURES, "2": [*EXPOSURES, *CONTROLS], "3": [*EXPOSURES, *CONTROLS, "years", "band_b", "band_c"], "4": [*EXPOSURES, *CONTROLS, "years", "band_b", "band_c"]}


def grid_units(t) -> DataFrame:
    """Units with every column of the main grid."""
    return units(t).withColumns({"years": (c("year") - 1995).cast("double"), "band_b": (c("band") == "b").cast("double"), "band_c": (c("band") == "c").cast("double")})


def main_family() -> G.Family:
    specs = {f"{y}/{design}": (y, right) for y in OUTCOMES for design, right in DESIGNS.items()}
    return G.Family(specs, tuple(EFFECTS), tuple(m for m in specs if m.endswith("/4")))


def binary_family() -> G.Family:
    return G.Family({y: (y, ["community", *CONTROLS]) for y in ("low", "middle", "severe")}, tuple(EFFECTS))


SEVERE = ("severe", "severe_unit", "severe_both")


def severe_family() -> G.Family:
    return G.Family({y: (y, ["community", *CONTROLS]) for y in SEVERE}, tuple(EFFECTS))


def variants_family() -> G.Family:
    return G.Family({f"{y}_{x}": (y, [x, *CONTROLS]) for y in OUTCOMES for x in EXPOSURES}, tuple(EFFECTS))


def household_family() -> G.Family:
    return G.Family({y: (y, ["household", *CONTROLS]) for y in OUTCOMES})


#: Models of the samples: three outcomes under weights of their own, or with a least number of other households.
SAMPLED = {y: (y, ["community", *CONTROLS]) for y in OUTCOMES}
WEIGHTED = {"A": "equal", "B": "weight", "C": "one"}
SUPPORTED = {f"support_{least}": least for least in (1, 5, 10)}


def families(t, listed: dict[str, G.Family]) -> dict[str, DataFrame]:
    """Tables of families, pooled and by region, from one reading of the units."""
    return {k: table(t, fits) for k, fits in G.fit_grids(grid_units(t), listed, "weight", "o_custkey", "n_regionkey").items()}


@query()
def g10_model_grid(t):
    """Three outcomes by four nested designs, pooled and by every region; the last design adds the region effects, which are constant within a region."""
    return families(t, {"main": main_family()})["main"]


_KNOWN = "select n_regionkey, o_custkey, l_extendedprice is not null y1, l_extendedprice / nullif(l_quantity, 0) is not null y2, a > 0 and b > 0 exposed, l_discount is not null and l_tax is not null block, l_shipdate is not null and l_quantity is not null trip"
_OTHERS = "select *, count(*) filter (o_orderstatus in ('F', 'O')) over (partition by o_custkey) - (o_orderstatus in ('F', 'O'))::INT a, count(o_orderstatus) over (partition by o_custkey) - (o_orderstatus is not null)::INT b from orders"


@query(
    f"""with o as ({_OTHERS}), u as ({_KNOWN} from lineitem join o on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey),
    s as (select 'ALL' scope, * from u union all select n_regionkey::VARCHAR, * from u),
    m as (select scope, outcome, design, o_custkey, case outcome when 'y2' then y2 else y1 end f1, f1 and exposed f2, f2 and (design = '1' or block) and (design < '3' or trip) f3 from s, (values ('y1'), ('y2'), ('low')) p(outcome), (values ('1'), ('2'), ('3'), ('4')) d(design)),
    n as (select scope, outcome, design, count(*) n0, count(*) filter (f1) n1, count(*) filter (f2) n2, count(*) filter (f3) n3, count(distinct o_custkey) filter (f3) clusters from m group by all)
    select scope, outcome, design, step, name, "left", excluded, clusters from n, lateral (values (0, 'start', n0, 0), (1, 'after_outcome', n1, n0 - n1), (2, 'after_exposure', n2, n1 - n2), (3, 'after_controls', n3, n2 - n3)) v(step, name, "left", excluded)"""
)
def g11_full_cascade(t):
    """Rows left and excluded at each step, and the clusters left at the end, for every outcome, design and scope of the main grid."""
    known = lambda names: F.lit(True) if not names else F.forall(F.array(*[c(x).isNotNull() for x in names]), lambda v: v)
    # the last design's effects are dummies of the region
    more = {d: [x for x in right if x not in EXPOSURES] + (["n_regionkey"] if d == "4" else []) for d, right in DESIGNS.items()}
    models = F.array(*[F.struct(F.lit(y).alias("outcome"), F.lit(d).alias("design"), c(y).isNotNull().alias("f1"), known(EXPOSURES).alias("f2"), known(extra).alias("f3")) for y in OUTCOMES for d, extra in more.items()])
    rows = grid_units(t).select("o_custkey", F.inline(models), F.array(F.lit("ALL"), c("n_regionkey").cast("string")).alias("scopes"))
    rows = rows.select("*", F.explode("scopes").alias("scope")).drop("scopes").where("scope is not null")
    by = ["scope", "outcome", "design"]
    steps = A.cascade(rows, [("after_outcome", c("f1")), ("after_exposure", c("f2")), ("after_controls", c("f3"))], by)
    clusters = rows.groupBy(*by).agg(F.countDistinct(F.when(c("f1") & c("f2") & c("f3"), c("o_custkey"))).alias("clusters"))
    return steps.join(F.broadcast(clusters), by).select(*by, "step", "name", "left", "excluded", "clusters")


@query()
def g12_binary_family(t):
    """15 linear-probability models: three binary outcomes, pooled and by region."""
    return families(t, {"binary": binary_family()})["binary"]


def severe_table(t, df: DataFrame, fits: dict[tuple[str, str], G.Fit]) -> DataFrame:
    """The severe models with each outcome's events, their share, and the regions that have none."""
    df = df.na.drop(subset=["community", *CONTROLS])
    sums = df.groupBy("n_regionkey").agg(n_rows(), *[F.sum(y).alias(y) for y in SEVERE])
    each = F.array(*[F.struct(F.lit(y).alias("outcome"), c(y).alias("e")) for y in SEVERE])
    events = sums.select("n", F.inline(each)).groupBy("outcome").agg(F.sum("e").cast("long").alias("events"), F.round(F.sum("e") / F.sum("n"), 8).alias("prevalence"), F.count_if(c("e") == 0).alias("regions_without"), F.count(F.lit(1)).alias("regions"))
    return table(t, fits).join(events, c("model") == c("outcome"), "left").drop("outcome")


@query()
def g13_severe_family(t):
    """Three severe outcomes, pooled, each with its events, their share, and the regions that have none."""
    df = units(t)
    return severe_table(t, df, G.fit_grids(df, {"": severe_family()}, "weight", "o_custkey")[""])


@query()
def g14_exposure_variants(t):
    """Six models: three outcomes with the exposure and with its broader coding."""
    return table(t, G.fit_grids(units(t), {"": variants_family()}, "weight", "o_custkey")[""])


def with_weights(df: DataFrame) -> DataFrame:
    """Units of the sampled models, with their weight at equal region totals and none."""
    df = df.na.drop(subset=["community", *CONTROLS])
    return W.equal_group_weights(df, "n_regionkey", "weight", scaled=True, name="equal").withColumn("one", F.lit(1.0))


def weight_samples() -> dict:
    return {label: (F.lit(True), w) for label, w in WEIGHTED.items()}


def support_samples() -> dict:
    return {label: (c("support") >= least, "weight") for label, least in SUPPORTED.items()}


@query()
def g16_weight_variants(t):
    """Nine models: three outcomes under equal region totals (A), the stated weight (B) and none (C)."""
    return table(t, G.fit_grid(with_weights(units(t)), SAMPLED, "weight", "o_custkey", None, EFFECTS, samples=weight_samples()))


@query()
def g15_household_baseline(t):
    return table(t, G.fit_grids(units(t), {"": household_family()}, "weight", "o_custkey")[""])


def support_table(t, fits: dict[tuple[str, str], G.Fit]) -> DataFrame:
    whole = {m: f.n for (label, m), f in fits.items() if label == "support_1"}
    kept = t.spark.createDataFrame([(label, m, f.n, round(100 * f.n / max(whole[m], 1), 6)) for (label, m), f in fits.items()], "scope string, model string, retained_n long, retained_percent double")
    return table(t, fits).join(kept, ["scope", "model"])


@query()
def g17_support_sensitivity(t):
    """Nine models: three outcomes on all units with an exposure and on those whose exposure rests on at least 5 and 10 other
    households; how many units each keeps, and their percent of all with one."""
    return support_table(t, G.fit_grid(units(t), SAMPLED, "weight", "o_custkey", None, EFFECTS, samples=support_samples()))


def written_units(t) -> DataFrame:
    """Units of all families, joined and written once."""
    used = [x for f in (main_family(), binary_family(), severe_family(), variants_family(), household_family()) for x in f.columns if x != "_one"]
    return stored(grid_units(t).select("o_custkey", "n_regionkey", "support", "weight", *dict.fromkeys(used)), "family-units")


def all_families(t, df: DataFrame) -> dict[str, DataFrame]:
    """Tables of seven families from written units: those with scopes, of which pooled ones keep ALL, in one pass, the samples in another."""
    pooled = {"severe": severe_family(), "variants": variants_family(), "household": household_family()}
    fits = G.fit_grids(df, {"main": main_family(), "binary": binary_family(), **pooled}, "weight", "o_custkey", "n_regionkey")
    fits |= {k: {key: f for key, f in fits[k].items() if key[0] == "ALL"} for k in pooled}
    sampled = G.fit_grid(with_weights(df), SAMPLED, "weight", "o_custkey", None, EFFECTS, samples=weight_samples() | support_samples())
    part = lambda labels: {key: f for key, f in sampled.items() if key[0] in labels}
    return {k: table(t, fits[k]) for k in ("main", "binary", "variants", "household")} | {"severe": severe_table(t, df, fits["severe"]), "weights": table(t, part(WEIGHTED)), "support": support_table(t, part(SUPPORTED))}


def sample_sizes(df: DataFrame) -> DataFrame:
    """scope, model, left: the rows that every column of a model of the main grid leaves, counted without a fit, by which columns are present first."""
    present = lambda names: F.coalesce(F.forall(F.array(*[c(x).isNotNull() for x in names]), lambda v: v), F.lit(False))
    parts = {f"_y{i}": [y] for i, y in enumerate(OUTCOMES)} | {f"_d{d}": [*right, *(["n_regionkey"] if d == "4" else [])] for d, right in DESIGNS.items()}
    counts = df.select("n_regionkey", *[present(names).alias(k) for k, names in parts.items()]).groupBy("n_regionkey", *parts).agg(n_rows())
    models = F.array(*[F.struct(F.lit(f"{y}/{d}").alias("model"), (c(f"_y{i}") & c(f"_d{d}")).alias("whole")) for i, y in enumerate(OUTCOMES) for d in DESIGNS])
    rows = counts.select("n", F.inline(models), F.array(F.lit("ALL"), c("n_regionkey").cast("string")).alias("scopes")).select("n", "model", "whole", F.explode("scopes").alias("scope"))
    return rows.where("scope is not null").groupBy("scope", "model").agg(F.sum(F.when(c("whole"), c("n")).otherwise(0)).alias("left"))


@query()
def g19_region_effects_models(t):
    """The model with region effects on its natural sample and on the sample that all models share."""
    samples = {"natural": (F.lit(True), "weight"), "common": (c("household").isNotNull(), "weight")}
    return table(t, G.fit_grid(units(t), {"region_effects": ("y1", ["community", *CONTROLS])}, "weight", "o_custkey", None, EFFECTS, samples=samples))


@query()
def g22_three_way_comparison(t):
    """Community, household and joint exposure on one sample."""
    blocks = {"community": ["community"], "household": ["household"], "joint": ["community", "household"]}
    return fitted(t, units(t), {name: ("y1", [*x, *CONTROLS]) for name, x in blocks.items()})


@query()
def g21_collinearity(t):
    """Inflation factors and R squared on the others of the joint model's regressors."""
    names = ["community", "household", *CONTROLS]
    g, n = G.gram(units(t).na.drop(subset=names).withColumn("_one", F.lit(1.0)), ["_one", *names], "weight")
    centred = g[1:, 1:] - np.outer(g[0, 1:], g[0, 1:]) / g[0, 0]
    rank, condition = G.scaled_rank(centred)
    return t.spark.createDataFrame([(x, round(float(v), 6), round(float(r), 6), rank, round(condition, 6), n) for x, v, r in zip(names, G.inflation(centred), G.dependence(centred), strict=True)], "term string, inflation double, r_squared double, rank int, condition double, n long")


@query()
def g23_linear_or_dummy_time(t):
    """Linear time against year effects, and whether the exposure's sign or significance changes."""
    df = units(t)
    years = [r[0] for r in df.select("year").distinct().orderBy("year").collect()]
    df = df.withColumns({f"year_{y}": (c("year") == y).cast("double") for y in years[1:]}).withColumn("time", c("year") - years[0])
    both = fitted(t, df, {"linear": ("y1", ["community", *CONTROLS, "time"]), "effects": ("y1", ["community", *CONTROLS, *[f"year_{y}" for y in years[1:]]])}).where("term = 'community'")
    wide = both.groupBy("scope").pivot("model", ["linear", "effects"]).agg(F.first("beta").alias("beta"), F.first("p").alias("p"))
    return wide.withColumns({"sign_changes": F.signum("linear_beta") != F.signum("effects_beta"), "significance_changes": (c("linear_p") < 0.05) != (c("effects_p") < 0.05)})


@query()
def g24_band_heterogeneity(t):
    """Exposure by band: interactions, the joint test of these, and the implied effect in each band."""
    df = units(t).withColumns({f"in_{b}": (c("band") == b).cast("double") for b in "bc"}).withColumns({f"community_{b}": c("community") * (c("band") == b).cast("double") for b in "bc"})
    rows = []
    for (scope, _), f in G.fit_grid(df, {"bands": ("y1", ["community", "community_b", "community_c", "in_b", "in_c", *CONTROLS])}, "weight", "o_custkey", "n_regionkey", EFFECTS).items():
        if f.status == "estimated":
            x, d, p = G.wald(f, ["community_b", "community_c"])
            i = f.terms.index("community")
            effects = {"a": (float(f.beta[i]), float(np.sqrt(f.cov[i, i])))} | {b: G.total_effect(f, "community", f"community_{b}") for b in "bc"}
            rows += [(scope, b, round(e, 7), round(s, 7), round(x, 6), d, round(p, 7)) for b, (e, s) in effects.items()]
    return t.spark.createDataFrame(rows, "scope string, band string, effect double, se double, chi2 double, df int, p double")


@query()
def g25_block_sequence(t):
    """The exposure's coefficient as blocks of controls are added one by one and left out one by one; one pass for all."""
    blocks = {"household": ["household"], "discount": ["l_discount"], "tax": ["l_tax"], "region": EFFECTS}
    specs, so_far = {"start": ("y1", ["community"])}, ["community"]
    for name, block in blocks.items():
        so_far = so_far + block
        specs[f"add_{name}"] = ("y1", so_far)
    specs |= {f"without_{name}": ("y1", ["community", *[x for other, b in blocks.items() if other != name for x in b]]) for name in blocks}
    return fitted(t, units(t), specs, None, []).where("term = 'community'")


@query()
def g27_models_by_group(t):
    """For each region the model with and without the absorbed cluster effects, and the support of the latter."""
    df = units(t).na.drop(subset=["community"])
    right = ("y1", ["community", *CONTROLS])
    fits = G.fit_grid(df, {"plain": right}, "weight", "o_custkey", "n_regionkey") | G.absorbed_grid(df, {"absorbed": right}, "weight", "o_custkey", "n_regionkey")
    return table(t, {key: f for key, f in fits.items() if key[0] != "ALL"})


@query()
def g40_own_and_common_sample(t):
    """Each exposure's model on its own sample and on the rows where every exposure is known."""
    exposures = ("community", "community_broad", "household")
    known = units(t).withColumns({f"known_{x}": c(x).isNotNull() for x in exposures}).na.fill(0.0, list(exposures))
    # a sample fits every exposure; only those that its rows have are kept
    samples = {x: (c(f"known_{x}"), "weight") for x in exposures} | {"common": (c("known_community") & c("known_community_broad") & c("known_household"), "weight")}
    found = G.fit_grid(known, {x: ("y1", [x, *CONTROLS]) for x in exposures}, "weight", "o_custkey", None, EFFECTS, samples=samples)
    return table(t, {("own" if sample == m else sample, m): f for (sample, m), f in found.items() if sample in (m, "common")})


@query(f"select n_regionkey, count(*) n, count(*) filter (where o_orderstatus <> 'P') n_household, round(100 * count(*) filter (where o_orderstatus <> 'P') / count(*), 6) percent from {HOUSEHOLDS} group by 1")
def g26_availability(t):
    return t.households.groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(c("o_orderstatus") != "P").alias("n_household"), F.round(100 * F.count_if(c("o_orderstatus") != "P") / F.count(F.lit(1)), 6).alias("percent"))


@query()
def e18_normal_or_t(t):
    """Interval and p-value of each coefficient under the normal law and under t with clusters less one."""
    rows = []
    for (scope, _), f in G.fit_grid(units(t), {"main": ("y1", ["community", *CONTROLS])}, "weight", "o_custkey", "n_regionkey").items():
        for term, b, se, p, low, high in f.rows():
            half = se * M.t_quantile(0.95, f.clusters - 1)
            rows.append((scope, term, *(round(float(v), 7) for v in (b, se, p, low, high, M.t_p(b / se, f.clusters - 1), b - half, b + half))))
    return t.spark.createDataFrame(rows, "scope string, term string, beta double, se double, p_normal double, low_normal double, high_normal double, p_t double, low_t double, high_t double")


@query()
def e20_inference_conventions(t):
    """One raw sandwich under the small-sample factors in use: none, N/(N-K), and (G/(G-1))((N-1)/(N-K))."""
    rows = []
    for (scope, _), f in G.fit_grid(units(t), {"main": ("y1", ["community", *CONTROLS])}, "weight", "o_custkey", "n_regionkey").items():
        if f.status == "estimated":
            i, usual = f.terms.index("community"), f.clusters / (f.clusters - 1) * (f.n - 1) / (f.n - f.k)
            raw = f.cov[i, i] / usual
            rows += [(scope, name, round(float(np.sqrt(raw * x)), 8)) for name, x in (("none", 1), ("rows", f.n / (f.n - f.k)), ("clusters_and_rows", usual))]
    return t.spark.createDataFrame(rows, "scope string, convention string, se double")


@query()
def e21_second_route(t):
    """Region effects as explicit columns against their absorption by demeaning: the largest difference of each coefficient."""
    df = stored(units(t).na.drop(subset=["community"]).select("o_custkey", "n_regionkey", "y1", "community", *CONTROLS, "weight", *EFFECTS), "units")
    explicit = G.fit_grid(df, {"m": ("y1", ["community", *CONTROLS])}, "weight", "o_custkey", None, EFFECTS)["ALL", "m"]
    absorbed = G.fit_absorbed(df, "y1", ["community"], CONTROLS, "weight", "n_regionkey")
    rows = [(x, round(float(explicit.beta[explicit.terms.index(x)]), 7), round(float(absorbed.beta[absorbed.terms.index(x)]), 7), bool(abs(explicit.beta[explicit.terms.index(x)] - absorbed.beta[absorbed.terms.index(x)]) < 1e-6)) for x in ("community", *CONTROLS)]
    return t.spark.createDataFrame(rows, "term string, explicit double, absorbed double, agrees boolean")


@query()
def r4_models_in_columns(t):
    """Terms in rows, models in columns, cells as coefficient (standard error), with a row of sample sizes."""
    rows = g22_three_way_comparison(t).where("scope = 'ALL'")
    cells = rows.select("model", "term", F.format_string("%.3f (%.3f)", "beta", "se").alias("cell"), F.lit(0).alias("part"))
    sizes = rows.select("model", F.lit("N").alias("term"), c("n").cast("string").alias("cell"), F.lit(1).alias("part")).distinct()
    return cells.unionByName(sizes).groupBy("part", "term").pivot("model", ["community", "household", "joint"]).agg(F.first("cell")).orderBy("part", "term")


@query()
def r5_scopes_in_columns(t):
    """The exposure's coefficient [interval] of each binary outcome, scopes in columns."""
    rows = g12_binary_family(t).where("term = 'community'")
    return rows.groupBy("model").pivot("scope", ["ALL", *map(str, range(REGIONS))]).agg(F.first(F.format_string("%.3f [%.3f, %.3f]", "beta", "low", "high")))
