"""The historical model grid and its windows on common samples: absorbed models, each on its own sample.

Units are line items, clusters customers, groups regions: regions 1 to 3 are the established ones, region 4 has three
candidate rules of its own. Columns are written once, in expressions that Spark and the SQL beside it share.
"""

from __future__ import annotations

from itertools import product as crossed

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.own_samples import Model, own_sample_grid

from .base import UNITS, query

WINDOWS = ("birth_year", "prenatal_9m", "post_12m", "post_24m")
PRODUCTS = {"a": "(l_discount * 100 + l_quantity)", "b": "(l_tax * 100 + l_linenumber * 3)"}
OUTCOMES = {"y1": "case when l_quantity < 50 then l_extendedprice / 10000 end", "y2": "l_extendedprice / l_quantity / 1000", "low": "case when l_extendedprice < 30000 then 1.0 else 0.0 end"}
#: An exposure is missing where its window is not complete.
WINDOW_RULES = {
    "birth_year": "case when year(l_shipdate) > 1992 then {p} + month(l_shipdate) end", "prenatal_9m": "case when month(l_shipdate) > 1 then {p} - day(l_shipdate) / 10.0 end",
    "post_12m": "case when month(l_shipdate) <= 11 then {p} end", "post_24m": "case when month(l_shipdate) <= 9 then {p} * (1 + cast(day(o_orderdate) as double) / 24) end",
    "post_12m_containing": "case when l_linenumber < 7 then floor({p}) end", "post_12m_rural10": "case when l_linestatus <> 'O' then {p} * 0.9 + 1 when month(l_shipdate) <= 11 then {p} end",
}
CONTROLS = {
    "age_reported": "case when o_orderpriority <> '2-HIGH' then day(l_shipdate) * 1.0 else day(l_shipdate) + month(o_orderdate) / 10.0 end", "age_calendar": "day(l_shipdate) + month(o_orderdate) / 10.0",
    "female": "case when l_returnflag = 'R' then 1.0 else 0.0 end", "wealth": "case when o_orderpriority <> '4-NOT SPECIFIED' then o_totalprice / 100000 end",
}
STRICTER = "day(l_shipdate) <= 20"
SAMPLES = {f"r{''.join(map(str, r))}": f"n_regionkey in ({', '.join(map(str, r))})" for r in ((1,), (2,), (3,), (1, 2, 3), (2, 3))}
SAMPLES |= {f"{k}_stricter": f"{v} and {STRICTER}" for k, v in SAMPLES.items()}
SAMPLES |= {"r4_first": "n_regionkey = 4 and day(o_orderdate) > 1", "r4_second": "n_regionkey = 4 and month(o_orderdate) <= 6", "r4_third": "n_regionkey = 4 and month(o_orderdate) > 6"}
COMMON = {"common": " and ".join(f"x_{p}_{w} is not null" for p in PRODUCTS for w in WINDOWS)}
COLUMNS = OUTCOMES | {f"x_{p}_{w}": rule.format(p=x) for (p, x), (w, rule) in crossed(PRODUCTS.items(), WINDOW_RULES.items())} | CONTROLS


def specs() -> list[dict]:
    """291 models: for each product and outcome 47, and 9 that leave out groups whose sources overlap."""
    out, established = [], ("r1", "r2", "r3", "r123")

    def add(family: str, p: str, y: str, sample: str, window: str = "post_12m", method: str = "primary", weighted: bool = True, age: str = "age_reported", wealth: bool = False) -> None:
        x = f"x_{p}_{window}" + ("" if method == "primary" else f"_{method}")
        out.append({"id": f"m{len(out) + 1:04d}", "family": family, "product": p, "outcome": y, "window": window, "method": method, "sample": sample, "weighted": weighted, "x": x, "age": age, "wealth": wealth})

    for p, y in crossed(PRODUCTS, OUTCOMES):
        for s in established:
            add("primary", p, y, s)
            add("unweighted", p, y, s, weighted=False)
            for w in ("birth_year", "prenatal_9m", "post_24m"):
                add("window", p, y, s, w)
            add("wealth", p, y, s, wealth=True)
            add("containing", p, y, s, method="containing")
            add("rural10", p, y, s, method="rural10")
            for w in ("post_12m", "post_24m"):
                add("stricter", p, y, f"{s}_stricter", w)
            add("calendar_age", p, y, s, age="age_calendar")
        for s in ("r4_first", "r4_second", "r4_third"):
            add("provisional", p, y, s)
    for y in OUTCOMES:
        add("overlap_without_1", "b", y, "r23")
        add("overlap_without_1_2", "a", y, "r3")
        add("overlap_without_1", "a", y, "r23")
    return out


def model(s: dict) -> Model:
    return Model(s["id"], s["outcome"], (s["x"],), (s["age"], "female", *(["wealth"] if s["wealth"] else [])), s["sample"], "qty" if s["weighted"] else None)


def units(t, flags: dict[str, str]) -> DataFrame:
    rows = t.units.select("o_custkey", "n_regionkey", F.col("l_quantity").alias("qty"), *[F.expr(e).alias(k) for k, e in COLUMNS.items()], *[F.expr(e).alias(k) for k, e in flags.items() if k != "common"])
    return rows.withColumns({k: F.expr(e) for k, e in flags.items() if k == "common"})


def own_sql(listed: list[dict], flags: dict[str, str]) -> str:
    """SQL for every model by demeaning its own rows and projecting the controls out one after the other."""
    u = f"select o_custkey g, n_regionkey grp, l_quantity qty, {', '.join(f'({e})::DOUBLE {k}' for k, e in COLUMNS.items())}, {', '.join(f'({e}) {k}' for k, e in flags.items() if k != 'common')} from {UNITS}"
    if "common" in flags:
        u = f"select *, ({flags['common']}) common from ({u})"
    case = lambda column, names: f"case {column} {' '.join(f'when {n!r} then {n}' for n in dict.fromkeys(names))} end"
    values = ", ".join(f"('{s['id']}', '{s['outcome']}', '{s['x']}', '{s['age']}', {s['wealth']}, '{s['sample']}', {s['weighted']})" for s in listed)
    pick = lambda key: [s[key] for s in listed]
    steps, kept = "", ["y", "x", "z1", "z2", "z3"]
    for i, z in enumerate(("z1", "z2", "z3")):
        kept = [k for k in kept if k != z]
        steps += f", r{i + 1} as (select id, g, v, wide, x0, {', '.join(f'{k} - coalesce(sum(v * {z} * {k}) over (partition by id) / nullif(sum(v * {z} * {z}) over (partition by id), 0), 0) * {z} {k}' for k in kept)} from {'d' if i == 0 else f'r{i}'})"
    return f"""(with u as ({u}), m(id, o, e, a, wide, s, weighted) as (values {values}),
        cells as (select id, wide, weighted, g, grp, case when weighted then qty else 1 end w, {case("o", pick("outcome"))} y, {case("e", pick("x"))} x, {case("a", pick("age"))} z1, female z2, case when wide then wealth else 0 end z3 from u join m on {case("s", pick("sample"))}),
        full_rows as (select *, count(*) over (partition by id, g) size from cells where y is not null and x is not null and z1 is not null and z2 is not null and z3 is not null),
        lone as (select id, count(*) singletons from full_rows where size = 1 group by 1),
        k as (select * from full_rows where size > 1),
        f as (select id, grp, sum(w) t from k group by 1, 2), c as (select id, count(*) n, count(distinct grp) groups from k group by 1),
        v as (select k.*, case when weighted then w * n / groups / t else 1 end v from k join f using (id, grp) join c using (id)),
        d as (select id, g, v, wide, x raw, {', '.join(f'{x} - sum(v * {x}) over p / sum(v) over p {x}' for x in ("y", "x", "z1", "z2", "z3"))}, x - sum(v * x) over p / sum(v) over p x0 from v window p as (partition by id, g)),
        d2 as (select id, count(*) filter (lo < hi) varying_clusters from (select id, g, min(raw) lo, max(raw) hi from d group by 1, 2) group by 1){steps},
        b as (select id, sum(v * x * y) / sum(v * x * x) beta, sum(v * x * x) xx, sum(v * x0 * x0) x0, sum(v) w, count(*) n, count(distinct g) clusters, any_value(wide) wide from r3 group by 1),
        sc as (select r3.id, g, sum(v * x * (y - beta * x)) s from r3 join b using (id) group by 1, 2), mt as (select id, sum(s * s) m from sc group by 1)
        select id, n, clusters, coalesce(singletons, 0) singletons, varying_clusters, beta, sqrt(m) / xx * sqrt(clusters / (clusters - 1) * ((n - 1) / (n - 3 - wide::INT))) se, sqrt(x0 / w) within_sd, sqrt(xx / w) residual_sd
        from b join mt using (id) join d2 using (id) left join lone using (id))"""


RESULT = "id string, family string, product string, outcome string, window string, method string, sample string, weighted boolean, status string, n long, clusters long, singletons long, varying_clusters long, beta double, se double, within_sd double, residual_sd double"
NUMBERS = "n, clusters, singletons, varying_clusters, round(beta, 6) beta, round(se, 6) se, round(within_sd, 6) within_sd, round(residual_sd, 6) residual_sd"


def table(t, listed: list[dict], flags: dict[str, str]) -> DataFrame:
    fits, rows = own_sample_grid(units(t, flags), [model(s) for s in listed], "o_custkey", "n_regionkey"), []
    for s in listed:
        f = fits[s["id"]]
        (_, beta, se, *_) = f.rows()[0] if f.status == "estimated" else (None, None, None)
        rounded = [None if v is None else round(float(v), 6) for v in (beta, se, f.more.get("within_sd"), f.more.get("residual_sd"))]
        rows.append((*[s[k] for k in ("id", "family", "product", "outcome", "window", "method", "sample", "weighted")], f.status, f.n, f.clusters, f.more["singletons"], f.more["varying"], *rounded))
    return t.spark.createDataFrame(rows, RESULT)


def result_sql(listed: list[dict], flags: dict[str, str]) -> str:
    labels = ", ".join("(" + ", ".join(f"'{s[k]}'" for k in ("id", "family", "product", "outcome", "window", "method", "sample")) + f", {s['weighted']})" for s in listed)
    return f"select l.*, 'estimated' status, {NUMBERS} from (values {labels}) l(id, family, product, outcome, \"window\", method, sample, weighted) join {own_sql(listed, flags)} using (id)"


def window_specs() -> list[dict]:
    """Every product, outcome and window on its own sample and on the rows where all windows are complete."""
    out = []
    for (p, y), w, (family, sample) in crossed(crossed(PRODUCTS, OUTCOMES), WINDOWS, (("own", "r123"), ("common", "common"))):
        out.append({"id": f"w{len(out) + 1:03d}", "family": family, "product": p, "outcome": y, "window": w, "method": "primary", "sample": sample, "weighted": True, "x": f"x_{p}_{w}", "age": "age_reported", "wealth": False})
    return out


WINDOW_SAMPLES = {"r123": SAMPLES["r123"], "common": f"r123 and {COMMON['common']}"}


@query(result_sql(specs(), SAMPLES))
def g39_historical_grid(t):
    """291 absorbed models, each on its own sample, with equal totals of the groups in it."""
    return table(t, specs(), SAMPLES)


@query(result_sql(window_specs(), WINDOW_SAMPLES))
def g40_windows_absorbed(t):
    """The windows' absorbed models on their own samples and on the common one."""
    return table(t, window_specs(), WINDOW_SAMPLES)
