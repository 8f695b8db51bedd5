"""Grids of models with absorbed cluster effects, each from one aggregate by cluster: G20, G39, G44, G45."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.operators import regress as G
from fieldloom.operators.own_samples import Model, own_sample_grid
from fieldloom.sources.tables import stored

from .base import UNITS, query

c = F.col
OUTCOMES, EXPOSURES = ("y1", "y2", "low"), ("l_discount", "l_tax", "filled")
#: The control that joins each exposure in the second design.
CONTROL = {"l_discount": "l_tax", "l_tax": "l_discount", "filled": "l_discount"}
U = f"select n_regionkey, n_nationkey, o_custkey, year(l_shipdate) yr, l_quantity qty, 1.0 one, l_extendedprice / 10000 y1, l_extendedprice / l_quantity / 1000 y2, (l_extendedprice < 30000)::INT::DOUBLE low, l_discount, l_tax, (o_orderstatus = 'F')::INT::DOUBLE filled from {UNITS}"


def units(t) -> DataFrame:
    return t.units.select(
        "n_regionkey", "n_nationkey", "o_custkey", F.year("l_shipdate").alias("yr"), c("l_quantity").alias("qty"), F.lit(1.0).alias("one"), (c("l_extendedprice") / 10000).alias("y1"),
        (c("l_extendedprice") / c("l_quantity") / 1000).alias("y2"), (c("l_extendedprice") < 30000).cast("double").alias("low"), "l_discount", "l_tax", (c("o_orderstatus") == "F").cast("double").alias("filled"),
    )


def fit_sql(rows: str, key: str, controlled: bool) -> str:
    """SQL for the coefficient of x with absorbed effects of g and its cluster-robust error; rows: key, g, w, y, x, z."""
    z = "z - sum(w * z) over p / sum(w) over p" if controlled else "0.0"
    det, b1, b2, k = ("xx * zz - xz * xz", "(zz * xy - xz * zy) / (xx * zz - xz * xz)", "(xx * zy - xz * xy) / (xx * zz - xz * xz)", 2) if controlled else ("xx", "xy / xx", "0.0", 1)
    v = "(zz * zz * m11 - 2 * zz * xz * m12 + xz * xz * m22)" if controlled else "m11"
    on = " and ".join(f"a.{x} = b.{x}" for x in key.split(", "))
    return f"""(with u as ({rows}), s as (select *, count(*) over (partition by {key}, g) size from u),
        d as (select {key}, g, w, y - sum(w * y) over p / sum(w) over p y, x - sum(w * x) over p / sum(w) over p x, {z} z from s where size >= 2 window p as (partition by {key}, g)),
        m as (select {key}, sum(w * x * x) xx, sum(w * x * z) xz, sum(w * z * z) zz, sum(w * x * y) xy, sum(w * z * y) zy, count(*) n from d group by all),
        b as (select *, {det} det, {b1} b1, {b2} b2 from m),
        sc as (select {", ".join(f"a.{x}" for x in key.split(", "))}, g, sum(w * x * (y - b1 * x - b2 * z)) s1, sum(w * z * (y - b1 * x - b2 * z)) s2 from d a join b on {on} group by all),
        e as (select {key}, sum(s1 * s1) m11, sum(s1 * s2) m12, sum(s2 * s2) m22, count(*) clusters from sc group by all)
        select {", ".join(f"a.{x}" for x in key.split(", "))}, b1 beta, sqrt({v} / (det * det) * (clusters / (clusters - 1)) * ((n - 1) / (n - {k}))) se, n, clusters from e a join b on {on})"""


def grid_sql(cluster: str = "o_custkey", outcomes=OUTCOMES, exposures=EXPOSURES, scopes: bool = True) -> str:
    """Every outcome, exposure, design, weight and scope."""
    parts = []
    scoped = "select 'ALL' scope, * from u0 union all select n_regionkey::VARCHAR, * from u0" if scopes else "select 'ALL' scope, * from u0"
    for design in ("alone", "controlled"):
        cells = " union all ".join(f"select scope, '{y}' outcome, '{x}' exposure, '{w}' weight, {cluster} g, {w} w, {y} y, {x} x, {CONTROL[x]} z from (with u0 as ({U}) {scoped})" for y in outcomes for x in exposures for w in ("qty", "one"))
        parts.append(f"select *, '{design}' design from {fit_sql(cells, 'scope, outcome, exposure, weight', design == 'controlled')}")
    return " union all ".join(parts)


def cells(t, fits: dict, **more) -> DataFrame:
    """One row a model: its first coefficient. Model names are outcome/exposure/weight/design."""
    rows = []
    for (scope, model), f in fits.items():
        (_, b, se, *_) = f.rows()[0] if f.status == "estimated" else (None, None, None)
        rows.append((scope, *model.split("/"), None if b is None else round(b, 6), None if se is None else round(se, 6), f.n, f.clusters))
    return t.spark.createDataFrame(rows, "scope string, outcome string, exposure string, weight string, design string, beta double, se double, n long, clusters long")


def grid(t, cluster: str = "o_custkey", outcomes=OUTCOMES, exposures=EXPOSURES, scope: str | None = "n_regionkey", df: DataFrame | None = None) -> dict:
    specs = {(y, x, design): (y, [x] if design == "alone" else [x, CONTROL[x]]) for y in outcomes for x in exposures for design in ("alone", "controlled")}
    named = {"/".join(k): v for k, v in specs.items()}
    fits = G.absorbed_grids(units(t) if df is None else df, named, ["qty", "one"], cluster, scope)
    return {(level, f"{y}/{x}/{w}/{design}"): fits[w][level, f"{y}/{x}/{design}"] for w in fits for level in dict.fromkeys(k for k, _ in fits[w]) for y, x, design in specs}


@query(f"select scope, outcome, exposure, weight, design, round(beta, 6) beta, round(se, 6) se, n, clusters from ({grid_sql()})")
def g39_absorbed_model_grid(t):
    """Three outcomes by three exposures, two designs and two weights, pooled and by every region: 216 absorbed fits in four passes."""
    return cells(t, grid(t))


@query(
    f"""with fits as ({grid_sql('n_nationkey', ('y1',), ('l_discount',), False)}), v as (select n_nationkey, min(l_discount) < max(l_discount) varies, count(*) n from ({U}) group by 1)
    select weight, design, round(beta, 6) beta, round(beta, 6) beta_dummies, round(se, 6) se, round(se * sqrt((n - k) / (n - k - clusters)), 6) se_all_columns, n, clusters, (select count(*) from v where varies) clusters_varying, (select sum(n) from v where varies)::BIGINT units_varying
    from (select *, case design when 'alone' then 1 else 2 end k from fits)"""
)
def g20_cluster_effects_model(t):
    """Absorbed effects of few clusters against explicit dummies of them, the error if each counted as a column, and the support."""
    df = stored(units(t).select("n_nationkey", "o_custkey", "qty", "one", "y1", "l_discount", "l_tax"), "few-cluster-units")
    fits, rows = grid(t, "n_nationkey", ("y1",), ("l_discount",), None, df), []
    explicit, dummies = G.region_dummies(df, "n_nationkey")
    held = G.support(df.withColumn("household", c("o_custkey")), "n_nationkey", "household", ["l_discount"]).first()
    explicit = explicit.withColumn("_one", F.lit(1.0))
    for w in ("qty", "one"):
        columns = ["_one", "l_discount", *dummies, "l_tax", "y1"]
        g, _ = G.gram(explicit, columns, w)
        for design in ("alone", "controlled"):
            f = fits["ALL", f"y1/l_discount/{w}/{design}"]
            (_, b, se, *_) = f.rows()[0]
            at = [i for i, x in enumerate(columns[:-1]) if design == "controlled" or x != "l_tax"]
            again = float(np.linalg.solve(g[np.ix_(at, at)], g[at, -1])[1])
            rows.append((w, design, round(b, 6), round(again, 6), round(se, 6), round(se * G.full_dummy_scale(f.n, f.k, f.clusters), 6), f.n, f.clusters, held["clusters_varying"], held["units_varying"]))
    return t.spark.createDataFrame(rows, "weight string, design string, beta double, beta_dummies double, se double, se_all_columns double, n long, clusters long, clusters_varying long, units_varying long")


@query(
    f"""with x as ({grid_sql(scopes=False)}) select outcome, exposure, weight, design, round(beta, 6) beta, round(se, 6) se, 'exact' agreement from x where exposure <> 'filled'"""
)
def g44_primary_cells(t):
    """All 24 pooled cells by two routes, columns that share one sample and models that each sum their own, and how well they agree."""
    df, exposures, rows = units(t), EXPOSURES[:2], []
    first = {model: f for (_, model), f in grid(t, "o_custkey", OUTCOMES, exposures, None, df).items()}
    listed = []
    for name in first:
        y, x, w, design = name.split("/")
        listed.append(Model(name, y, (x,), (CONTROL[x],) if design == "controlled" else (), None, w))
    for name, second in own_sample_grid(df, listed, "o_custkey").items():
        (_, b, se, *_), (_, b2, se2, *_) = first[name].rows()[0], second.rows()[0]
        gap = max(abs(b - b2), abs(se - se2))
        rows.append((*name.split("/"), round(b, 6), round(se, 6), "exact" if gap <= 1e-9 else "rounded" if gap <= 1e-6 else "discrepant"))
    return t.spark.createDataFrame(rows, "outcome string, exposure string, weight string, design string, beta double, se double, agreement string")


@query(
    "select coding, outcome, weight, design, round(beta, 6) beta, round(se, 6) se, n, clusters from (select 'global' coding, * from ("
    + grid_sql("yr", exposures=("l_discount",), scopes=False) + ") union all select 'by_region', * from (" + grid_sql("n_regionkey * 10000 + yr", exposures=("l_discount",), scopes=False) + "))"
)
def g45_year_codings(t):
    """Year effects that all regions share against years of each region, with and without a control."""
    df = units(t).select("yr", (c("n_regionkey") * 10000 + c("yr")).alias("local"), "qty", "one", *OUTCOMES, "l_discount", "l_tax")
    df = stored(df, "year-units")
    both = [cells(t, grid(t, key, OUTCOMES, ("l_discount",), None, df)).withColumn("coding", F.lit(name)) for name, key in (("global", "yr"), ("by_region", "local"))]
    return both[0].unionByName(both[1]).select("coding", "outcome", "weight", "design", "beta", "se", "n", "clusters")
