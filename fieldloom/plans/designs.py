"""Design diagnostics and codings of years, from products within clusters: G38, G45.

Units are line items, clusters customers, samples regions; region 4 has two candidate rules. The exposures by product and
window are those of the historical grid.
"""

from __future__ import annotations

from itertools import product as crossed

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.operators import designs as D
from fieldloom.operators import weights as W
from fieldloom.sources.tables import stored

from .base import UNITS, query
from .own_samples import COLUMNS, OUTCOMES, PRODUCTS, WINDOWS

c = F.col
DENSE = {"age": COLUMNS["age_reported"], "female": COLUMNS["female"], "urban": "case when l_linestatus = 'O' then 1.0 else 0.0 end"}
BLOCKS = {"year": "year(l_shipdate)", "month": "month(o_orderdate)"}
#: Samples and their rules; a unit may be in both of region 4.
SAMPLES = {f"r{i}": f"n_regionkey = {i}" for i in range(4)} | {"r4_second": "n_regionkey = 4 and month(o_orderdate) <= 9", "r4_third": "n_regionkey = 4 and month(o_orderdate) > 3"}
CELLS = list(crossed(PRODUCTS, WINDOWS, OUTCOMES))


def design_rows(t) -> DataFrame:
    """A row for each unit, with a flag for each sample."""
    rows = {x: F.expr(e).cast("double").alias(x) for x, e in (DENSE | {f"x_{p}_{w}": COLUMNS[f"x_{p}_{w}"] for p, w in crossed(PRODUCTS, WINDOWS)}).items()}
    # an outcome only says which rows are complete
    known = [F.when(F.expr(e).isNotNull(), 1.0).alias(y) for y, e in OUTCOMES.items()]
    return t.units.select("o_custkey", *rows.values(), *known, *[F.expr(e).alias(k) for k, e in BLOCKS.items()], *[F.expr(e).alias(k) for k, e in SAMPLES.items()])


def designs() -> dict[str, D.Design]:
    """By sample/product/window/outcome."""
    return {f"{s}/{p}/{w}/{y}": D.Design((f"x_{p}_{w}", *DENSE), s, (y,)) for s, (p, w, y) in crossed(SAMPLES, CELLS)}


def diagnosed(t) -> list[tuple[list[str], str, D.Within, dict]]:
    """(sample, product, window, outcome), variant, products, diagnostics; with month dummies for the first outcome only."""
    out = []
    for design, g in sorted(D.within(design_rows(t), designs(), "o_custkey", ["e", *DENSE], list(BLOCKS)).items()):
        key = design.split("/")
        columns = [*g.block("year")[1:], *DENSE]
        out.append((key, "proposed", g, g.diagnostics("e", columns)))
        if key[3] == next(iter(OUTCOMES)):
            out.append((key, "plus_months", g, g.diagnostics("e", [*columns, *g.block("month")[1:]])))
    return out


def variation_sql() -> str:
    """The same by projecting one column out after the other."""
    u = f"select o_custkey g, {', '.join(f'({e})::DOUBLE {k}' for k, e in (DENSE | OUTCOMES).items())}, {BLOCKS['year']} yr, {', '.join(f'({COLUMNS[f"x_{p}_{w}"]})::DOUBLE x_{p}_{w}' for p, w in crossed(PRODUCTS, WINDOWS))}, list_filter([{', '.join(f"case when {e} then '{k}' end" for k, e in SAMPLES.items())}], lambda s: s is not null) samples from {UNITS}"
    case = " ".join(f"when '{p}/{w}/{y}' then case when {y} is not null then x_{p}_{w} end" for p, w, y in CELLS)
    years = 10
    zs = [*DENSE, *[f"y{k}" for k in range(1, years)]]
    kept, steps = ["e", *zs], ""
    for i, z in enumerate(zs):
        kept = [k for k in kept if k != z]
        steps += f", r{i + 1} as (select id, e0, {', '.join(f'{k} - coalesce(sum({z} * {k}) over p / nullif(sum({z} * {z}) over p, 0), 0) * {z} {k}' for k in kept)} from {f'r{i}' if i else 'd'} window p as (partition by id))"
    return f"""with u as ({u}), s as (select *, unnest(samples) AS sample from u), m as (select *, unnest([{', '.join(f"'{p}/{w}/{y}'" for p, w, y in CELLS)}]) AS cell from s),
        k0 as (select sample || '/' || cell id, g, {', '.join(DENSE)}, yr, case cell {case} end e from m), k as (select *, yr - min(yr) over (partition by id) dy from k0 where e is not null),
        n as (select id, g, count(*) n, min(e) < max(e) v from k group by 1, 2), w as (select id, sum(n)::BIGINT n, count(*) clusters, count(*) filter (n = 1) singletons, count(*) filter (v) clusters_varying from n group by 1),
        d as (select id, e - avg(e) over p e, e - avg(e) over p e0, {', '.join(f'{x} - avg({x}) over p {x}' for x in DENSE)}, {', '.join(f'(dy = {i})::INT - avg((dy = {i})::INT) over p y{i}' for i in range(1, years))} from k window p as (partition by id, g)){steps}
        select split_part(id, '/', 1) AS sample, split_part(id, '/', 2) product, split_part(id, '/', 3) AS "window", split_part(id, '/', 4) outcome, n, clusters, singletons, clusters_varying,
            round(sqrt(sum(e0 * e0) / (n - 1)), 6) within_sd, round(sqrt(sum(e * e) / (n - 1)), 6) residual_sd, round(sum(e * e) / sum(e0 * e0), 6) residual_share from r{len(zs)} join w using (id) group by id, n, clusters, singletons, clusters_varying"""


@query(variation_sql())
def g38_exposure_after_controls(t):
    """What years and controls leave of each exposure within clusters, for every sample, product, window and outcome."""
    rows = [(*key, g.n, g.clusters, g.singletons, g.varying, *(round(d[k], 6) for k in ("within_sd", "residual_sd", "residual_share"))) for key, variant, g, d in diagnosed(t) if variant == "proposed"]
    return t.spark.createDataFrame(rows, "sample string, product string, window string, outcome string, n long, clusters long, singletons long, clusters_varying long, within_sd double, residual_sd double, residual_share double")


@query()
def g38_design_ranks(t):
    """Columns proposed, absorbed and used, rank, condition number and exact dependence of each design, and with interview months."""
    rows = [
        (*key, variant, g.n, d["columns"], d["used"], ",".join(d["absorbed"]), d["rank"], round(d["condition"], 4) if d["condition"] < 1e6 else None, ",".join(d["dependent"]), round(d["residual_sd"], 6), round(d["residual_share"], 6))
        for key, variant, g, d in diagnosed(t)
    ]
    return t.spark.createDataFrame(rows, "sample string, product string, window string, outcome string, variant string, n long, columns int, used int, absorbed string, rank int, condition double, dependent string, residual_sd double, residual_share double")


@query()
def g45_nuisance_spaces(t):
    """Years of each region with its own first year as reference, or with one for all: ranks, residual exposures and coefficients.

    Each region counts years from its own start, as surveys of different years do.
    """
    rows = t.units.select("o_custkey", "n_regionkey", c("l_quantity").alias("qty"), F.expr(COLUMNS["x_a_post_12m"]).cast("double").alias("e"), *[F.expr(e).alias(k) for k, e in (DENSE | OUTCOMES).items()], F.concat_ws(":", "n_regionkey", F.year("l_shipdate") + c("n_regionkey")).alias("year"))
    # the units are joined once; weights, levels, products and residuals read what is written here
    rows = W.equal_group_weights(stored(rows.na.drop(), "coded-units"), "n_regionkey", "qty", scaled=True, name="w")
    levels = sorted(tuple(r[0].split(":")) for r in rows.select("year").distinct().limit(D.MOST_LEVELS).collect())
    first = {g: min(y for h, y in levels if h == g) for g, _ in levels}
    codings = {"own_reference": [f"{g}:{y}" for g, y in levels if y != first[g]], "one_reference": [f"{g}:{y}" for g, y in levels if y != min(first.values())]}
    modes = {"with_age": ["age", "female", "urban"], "without_age": ["female", "urban"]}
    out = []
    for mode, found in D.compare_codings(rows, "o_custkey", list(OUTCOMES), "e", modes, "year", codings, "w").items():
        for name, coding in found.codings.items():
            out += [(mode, name, y, len(codings[name]), *found.alone, *found.given, coding.rank, round(b, 7), round(coding.residual_norm, 5), found.relative_gap < 1e-8, found.equal, found.n, found.clusters) for y, b in coding.beta.items()]
    return t.spark.createDataFrame(out, "controls string, coding string, outcome string, columns int, rank_own int, rank_one int, rank_both int, rank_own_given int, rank_one_given int, rank_both_given int, rank int, beta double, residual_norm double, same_residuals boolean, equal boolean, n long, clusters long")
