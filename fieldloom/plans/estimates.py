"""Queries of estimators, contracts, functions and reports: A18, A19, E, F, Q, R, G, S."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions import calendar as C
from fieldloom.operators import aggregates as A
from fieldloom.operators import contracts as K
from fieldloom.operators import regress as G
from fieldloom.operators import survey as S
from fieldloom.operators import weights as W
from fieldloom.sources import fixed_width as X
from fieldloom.sources import tables as T
from fieldloom.sources.tables import new_folder

from .absorbed import fit_sql
from .base import HOUSEHOLDS, UNITS, n_rows, query

c = F.col
TERMS = "model string, status string, term string, beta double, se double, n long, clusters long, k int"


def model_rows(t) -> DataFrame:
    return t.units.select("n_regionkey", "c_nationkey", "o_custkey", "o_orderkey", "l_quantity", "l_discount", "l_tax", (c("l_extendedprice") / 1000).alias("y"), (c("o_orderstatus") == "F").cast("double").alias("filled"))


def terms(t, fits: dict[str, G.Fit]) -> DataFrame:
    """Named result rows; a refused fit has one row without a term."""
    rows = []
    for name, f in fits.items():
        rows += [(name, f.status, term, round(b, 7), round(se, 7), f.n, f.clusters, f.k) for term, b, se, *_ in f.rows()] or [(name, f.status, None, None, None, f.n, f.clusters, f.k)]
    return t.spark.createDataFrame(rows, TERMS)


GRAM_SQL = f"select {{}} from (select l_extendedprice / 1000 y, l_discount x, l_tax z, l_quantity w, o_custkey g from {UNITS})"


@query(GRAM_SQL.format("round(sum(w * x * x), 5) xx, round(sum(w * x * z), 5) xz, round(sum(w * z * z), 5) zz, round(sum(w * x * y), 3) xy, round(sum(w * z * y), 3) zy, count(*) n"))
def a18_gram(t):
    g, n = G.gram(model_rows(t), ["l_discount", "l_tax", "y"], "l_quantity")
    return t.spark.createDataFrame([(*[round(float(g[i, j]), d) for i, j, d in ((0, 0, 5), (0, 1, 5), (1, 1, 5), (0, 2, 3), (1, 2, 3))], n)], "xx double, xz double, zz double, xy double, zy double, n long")


@query(f"select round(sum(s * s), 2) meat, count(*) clusters from (select g, sum(w * x * (y - 5 * x)) s from ({GRAM_SQL.format('*')}) group by 1)")
def a19_meat(t):
    m, clusters = G.meat(model_rows(t), ["l_discount"], c("y") - 5 * c("l_discount"), "l_quantity", "o_custkey")
    return t.spark.createDataFrame([(round(float(m[0, 0]), 2), clusters)], "meat double, clusters long")


DESIGN = f"""
    with r as (select c_nationkey s, o_custkey c, o_totalprice / 1000 w, {{y}} y from {HOUSEHOLDS}),
    k as (select s, c, sum(w) w, sum(w * y) wy, count(*) n from r where y is not null group by 1, 2),
    t as (select sum(wy) / sum(w) m, sum(w) ww from k),
    z as (select s, (wy - m * w) / ww z, n, m from k, t),
    v as (select s, count(*) k, var_samp(z) v, sum(n) n, first(m) m from z group by 1)
    select round(first(m), 8) mean, round(sqrt(sum(k * v)), 8) se, (sum(k) - count(*))::BIGINT df, sum(n)::BIGINT n from v"""


def interval_sql(source: str, keys: str = "") -> str:
    """source (mean, se, df, n and keys) with low and high: the t law's quantile by Newton steps on Simpson sums of its density."""
    density = "exp(lgamma((df + 1) / 2.0) - lgamma(df / 2.0)) / sqrt(df * pi()) * pow(1 + {x} * {x} / df, -(df + 1) / 2.0)"
    area = f"q / 6000 * list_sum(list_transform(range(2001), lambda i: (case when i = 0 or i = 2000 then 1 when i % 2 = 1 then 4 else 2 end) * {density.format(x='(q * i / 2000)')}))"
    steps, last = f"q0 as (select *, 2.0::DOUBLE q from ({source}))", "q0"
    for i in range(1, 7):
        steps += f", q{i} as (select * exclude (q), q - ({area} - 0.475) / ({density.format(x='q')}) q from {last})"
        last = f"q{i}"
    bound = lambda sign: f"1 / (1 + exp(-(ln(mean / (1 - mean)) {sign} q * se / (mean * (1 - mean)))))"
    return f"with {steps} select {keys}mean, se, df, n, {bound('-')} low, {bound('+')} high from {last}"


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({x: F.round(x, digits) for x in columns})


@query(DESIGN.format(y="c_acctbal"))
def e1_design_mean(t):
    return rounded(S.design_mean(t.households.withColumn("w", c("o_totalprice") / 1000), c("c_acctbal"), "w", "c_nationkey", "o_custkey"), 8, "mean", "se")


@query(f"select round(mean, 8) mean, round(se, 8) se, df, n, round(low, 6) low, round(high, 6) high from ({interval_sql(DESIGN.format(y="(o_orderstatus = 'F')::INT").replace('round(first(m), 8)', 'first(m)').replace('round(sqrt(sum(k * v)), 8)', 'sqrt(sum(k * v))'))})")
def e2_design_proportion(t):
    out = S.design_proportion(t.households.withColumn("w", c("o_totalprice") / 1000), (c("o_orderstatus") == "F").cast("int"), "w", "c_nationkey", "o_custkey")
    return rounded(rounded(out, 8, "mean", "se"), 6, "low", "high")


@query("select c_nationkey from customer group by 1 having count(*) = 1")
def e3_singleton_strata(t):
    return S.singleton_strata(t.customer, "c_nationkey", "c_custkey").select("c_nationkey")


@query()
def e4_explicit_regression(t):
    rows, fe = G.region_dummies(model_rows(t), "n_regionkey")
    return terms(t, {"region_effects": G.fit_explicit(rows, "y", ["l_discount", "l_tax", *fe], "l_quantity", "o_custkey")})


@query(
    f"""with u as ({GRAM_SQL.format('*')}), m as (select sum(w) sw, sum(w * x) sx, sum(w * y) sy, sum(w * x * y) sxy, sum(w * x * x) sxx, count(*) n from u),
    b as (select *, sw * sxx - sx * sx det, (sw * sxy - sx * sy) / (sw * sxx - sx * sx) b1, (sxx * sy - sx * sxy) / (sw * sxx - sx * sx) b0 from m),
    s as (select g, sum(w * (y - b0 - b1 * x)) s0, sum(w * x * (y - b0 - b1 * x)) s1 from u, b group by 1), e as (select sum(s0 * s0) m00, sum(s0 * s1) m01, sum(s1 * s1) m11, count(*) clusters from s)
    select round(b1, 6) beta, round(sqrt((sx * sx * m00 - 2 * sx * sw * m01 + sw * sw * m11) / (det * det) * (clusters / (clusters - 1)) * ((n - 1) / (n - 2))), 6) se, n, clusters from b, e"""
)
def e5_cluster_robust(t):
    """The slope of one regressor and its cluster-robust standard error, with the small-sample factor."""
    f = G.fit_explicit(model_rows(t), "y", ["l_discount"], "l_quantity", "o_custkey")
    _, (_, b, se, *_) = f.rows()
    return t.spark.createDataFrame([(round(b, 6), round(se, 6), f.n, f.clusters)], "beta double, se double, n long, clusters long")


def _absorbed_sql(select: str) -> str:
    """The absorbed fit of both regressors, one row each."""
    rows = f"select 1 one, o_custkey g, l_quantity w, l_extendedprice / 1000 y, {{}} x, {{}} z from {UNITS}"
    pairs = (("l_discount", "l_tax"), ("l_tax", "l_discount"))
    return " union all ".join(f"select {select.format(term=x)} from {fit_sql(rows.format(x, z), 'one', True)}" for x, z in pairs)


@query(_absorbed_sql("'absorbed' model, 'estimated' status, '{term}' term, round(beta, 7) beta, round(se, 7) se, n, clusters, 2 k"))
def e6_absorbed_regression(t):
    return terms(t, {"absorbed": G.fit_absorbed(model_rows(t), "y", ["l_discount"], ["l_tax"], "l_quantity", "o_custkey")})


ABSORBED = f"""
    with u as (select l_extendedprice / 1000 y, l_discount x, l_tax z, l_quantity q, o_custkey g, n_regionkey r from {UNITS}),
    s as (select * from (select *, count(*) over (partition by g) k from u) where k >= 2),
    w as (select *, q / sum(q) over (partition by r) * (select count(*) / count(distinct r) from s) w from s),
    d as (select g, w, y - sum(w * y) over p / sum(w) over p y, x - sum(w * x) over p / sum(w) over p x, z - sum(w * z) over p / sum(w) over p z from w window p as (partition by g)),
    m as (select sum(w * x * x) xx, sum(w * x * z) xz, sum(w * z * z) zz, sum(w * x * y) xy, sum(w * z * y) zy, count(*) n from d),
    b as (select *, xx * zz - xz * xz det, (zz * xy - xz * zy) / (xx * zz - xz * xz) b1, (xx * zy - xz * xy) / (xx * zz - xz * xz) b2 from m),
    c as (select g, sum(w * x * (y - b1 * x - b2 * z)) s1, sum(w * z * (y - b1 * x - b2 * z)) s2 from d, b group by 1),
    e as (select sum(s1 * s1) m11, sum(s1 * s2) m12, sum(s2 * s2) m22, count(*) k from c)
    select round(b1, 6) beta_x, round(b2, 6) beta_z, round(sqrt((zz * zz * m11 - 2 * zz * xz * m12 + xz * xz * m22) / (det * det) * (k / (k - 1)) * ((n - 1) / (n - 2))), 6) se_x, n, k clusters from b, e"""


@query(ABSORBED)
def e7_absorbed_fe(t):
    f = G.fit_absorbed(model_rows(t), "y", ["l_discount"], ["l_tax"], "l_quantity", "o_custkey", "n_regionkey")
    (_, b1, se, *_), (_, b2, *_) = f.rows()
    return t.spark.createDataFrame([(round(b1, 6), round(b2, 6), round(se, 6), f.n, f.clusters)], "beta_x double, beta_z double, se_x double, n long, clusters long")


@query(_absorbed_sql("'{term}' term, round(se, 7) se, round(se * sqrt((n - 2) / (n - 2 - clusters)), 7) se_full"))
def e8_full_dummy_sensitivity(t):
    f = G.fit_absorbed(model_rows(t), "y", ["l_discount"], ["l_tax"], "l_quantity", "o_custkey")
    scale = G.full_dummy_scale(f.n, f.k, f.clusters)
    return t.spark.createDataFrame([(term, round(se, 7), round(se * scale, 7)) for term, _, se, *_ in f.rows()], "term string, se double, se_full double")


@query()
def e9_rank_and_condition(t):
    rows = model_rows(t).withColumn("copy", 2 * c("l_tax"))
    out = []
    for name, x in {"sound": ["l_discount", "l_tax"], "dependent": ["l_discount", "l_tax", "copy"]}.items():
        g, _ = G.gram(rows, x, "l_quantity")
        rank, condition = G.scaled_rank(g)
        out.append((name, len(x), rank, condition if condition < 1e9 else None))
    return t.spark.createDataFrame(out, "design string, columns int, rank int, condition double")


@query()
def e10_inflation(t):
    rows = W.demean(model_rows(t).withColumn("all_rows", F.lit(1)), "o_custkey", ["l_discount", "l_tax", "y"])
    g, _ = G.gram(rows.withColumn("one", F.lit(1.0)), ["l_discount", "l_tax", "y"], "one")
    return t.spark.createDataFrame([(x, round(float(v), 7), round(float(r), 7)) for x, v, r in zip(["l_discount", "l_tax", "y"], G.inflation(g), G.dependence(g), strict=True)], "term string, vif double, r_squared double")


@query(_absorbed_sql("'{term}' term, round(beta, 7) beta"))
def e14_partial_regression(t):
    rows = W.demean(model_rows(t), "o_custkey", ["l_discount", "l_tax", "y"], c("l_quantity"))
    g, _ = G.gram(rows, ["l_discount", "l_tax", "y"], "l_quantity")
    return t.spark.createDataFrame([(x, round(G.partial_beta(g, i, 2), 7)) for i, x in enumerate(["l_discount", "l_tax"])], "term string, beta double")


@query()
def e16_joint_test(t):
    f = G.fit_explicit(model_rows(t), "y", ["l_discount", "l_tax"], "l_quantity", "o_custkey")
    x, df, p = G.wald(f, ["l_discount", "l_tax"])
    return t.spark.createDataFrame([(round(x, 6), df, round(p, 6))], "chi2 double, df int, p double")


@query()
def e17_total_effect(t):
    rows = model_rows(t).withColumn("x_high", c("l_discount") * (c("l_quantity") > 25).cast("int"))
    f = G.fit_explicit(rows, "y", ["l_discount", "x_high"], "l_quantity", "o_custkey")
    b, se = G.total_effect(f, "l_discount", "x_high")
    return t.spark.createDataFrame([(round(b, 6), round(se, 6))], "effect double, se double")


@query(f"with v as (select o_custkey, min(l_discount) < max(l_discount) v, count(*) u, count(distinct o_orderkey) h from {UNITS} group by 1) select count(*) clusters, count(*) filter (where v) clusters_varying, sum(case when v then h else 0 end)::BIGINT households_varying, sum(case when v then u else 0 end)::BIGINT units_varying from v")
def e19_support(t):
    return G.support(t.units, "o_custkey", "o_orderkey", ["l_discount"])


@query(f"select round(corr(date_diff('day', o_orderdate::DATE, l_shipdate::DATE), year(l_shipdate)), 8) r, max(abs((year(o_orderdate) - 1900) * 12 + month(o_orderdate) - 1 - date_diff('month', DATE '1900-01-01', o_orderdate::DATE)))::INT identity_gap from {UNITS}")
def e22_identity_check(t):
    """How the time since the order and the year go together, and whether the month index counts months from its epoch."""
    days = F.date_diff(c("l_shipdate").cast("date"), c("o_orderdate").cast("date"))
    counted = F.months_between(F.trunc("o_orderdate", "month"), F.lit("1900-01-01").cast("date")).cast("int")
    gap = F.abs(C.month_index(F.year("o_orderdate"), F.month("o_orderdate")) - 1 - counted)
    return t.units.agg(F.round(F.corr(days, F.year("l_shipdate")), 8).alias("r"), F.max(gap).cast("int").alias("identity_gap"))


# functions


@query("select o_orderkey, upper(substr(o_orderpriority, 3)) as word, lpad(o_custkey::VARCHAR, 8, '0') code, starts_with(o_orderpriority, '1') urgent from orders")
def f1_strings(t):
    return t.orders.select("o_orderkey", F.upper(F.substring("o_orderpriority", 3, 100)).alias("word"), F.lpad(c("o_custkey").cast("string"), 8, "0").alias("code"), c("o_orderpriority").startswith("1").alias("urgent"))


@query("select event_id, len(regexp_extract_all(props, '[0-9]+')) n_numbers from events")
def f2_regex_groups(t):
    return t.events.select("event_id", F.size(F.regexp_extract_all("props", F.lit("[0-9]+"), F.lit(0))).cast("long").alias("n_numbers"))


@query("select o_orderpriority, format('{} ({})', count(*), count(distinct o_custkey)) cell from orders group by 1")
def f3_formatted_cells(t):
    return t.orders.groupBy("o_orderpriority").agg(F.format_string("%d (%d)", F.count(F.lit(1)), F.countDistinct("o_custkey")).alias("cell"))


@query("select o_orderkey, ((year(o_orderdate) - 1900) * 12 + month(o_orderdate))::INT cmc, year(o_orderdate)::INT y from orders")
def f4_month_index(t):
    cmc = C.month_index(F.year("o_orderdate"), F.month("o_orderdate"))
    return t.orders.select("o_orderkey", cmc.alias("cmc"), C.year_of(cmc).cast("int").alias("y"))


@query()
def f5_other_calendar(t):
    year, month, day = F.year("o_orderdate") - 8, F.month("o_orderdate"), F.least(F.day("o_orderdate"), F.lit(30))
    return t.orders.select("o_orderkey", C.other_to_gregorian(year, month, day).alias("gregorian"))


@query("select y, (y % 4 = 0 and (y % 100 <> 0 or y % 400 = 0)) leap, count(*) n from (select year(o_orderdate)::INT y from orders) group by 1, 2")
def f9_leap_years(t):
    y = F.year("o_orderdate")
    return t.orders.groupBy(y.alias("y"), C.is_leap(y).alias("leap")).agg(n_rows())


@query("select o_orderkey, date_trunc('month', o_orderdate) + interval 1 month - interval 1 day - date_trunc('day', o_orderdate) <= interval 2 day near_end from orders")
def f7_near_month_end(t):
    return t.orders.select("o_orderkey", (F.date_diff(F.last_day("o_orderdate"), c("o_orderdate").cast("date")) <= 2).alias("near_end"))


# contracts


@query("select count(*) n_rows, count(distinct o_orderkey) n_keys from orders")
def q2_row_counts(t):
    return t.orders.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("o_orderkey").alias("n_keys"))


@query("select l_orderkey, l_linenumber, count(*) n from lineitem group by 1, 2 having count(*) > 1")
def q3_unique_key(t):
    return K.unique_key(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("select o_custkey from orders where o_orderkey % 97 = 0 group by 1")
def q4_rows_preserved(t):
    return K.same_rows(t.orders, t.orders.where("o_orderkey % 97 <> 0"), ["o_custkey"]).select("o_custkey")


@query("select 'o_totalprice' contract, count(*) filter (where o_orderkey % 50 = 0)::BIGINT violations from orders union all select 'o_orderstatus', 0")
def q5_unchanged_columns(t):
    after = t.orders.withColumn("o_totalprice", F.when(c("o_orderkey") % 50 == 0, c("o_totalprice") + 1).otherwise(c("o_totalprice")))
    return K.unchanged(t.orders, after, "o_orderkey", ["o_totalprice", "o_orderstatus"])


@query("select (select count(*) from orders) total, (select sum(n) from (select count(*) n from orders group by o_orderstatus))::BIGINT parts")
def q6_counts_reconcile(t):
    """The table's rows against the sum of its parts, counted apart."""
    parts = t.orders.groupBy("o_orderstatus").agg(n_rows()).agg(F.sum("n").alias("parts"))
    return t.orders.agg(F.count(F.lit(1)).alias("total")).crossJoin(F.broadcast(parts))  # one row each


@query("select l_orderkey, count(distinct l_returnflag) n_values from lineitem group by 1 having count(distinct l_returnflag) > 1")
def q7_dependency(t):
    return K.depends(t.lineitem, "l_orderkey", "l_returnflag")


@query("select contract, violations from (select count(*) filter (where l_quantity > 45 and l_quantity <= 40) a, count(*) filter (where l_discount not in (0, 1) and l_discount > 0.1) b, count(*) filter (where l_extendedprice <= 0) c from lineitem), lateral (values ('implies', a), ('domain', b), ('positive', c)) v(contract, violations)")
def q9_rules(t):
    return K.rules(t.lineitem, {"implies": (c("l_quantity") > 45) & (c("l_quantity") <= 40), "domain": ~c("l_discount").isin(0.0, 1.0) & (c("l_discount") > 0.1), "positive": c("l_extendedprice") <= 0})


@query(f"with t as (select n_regionkey, sum(o_totalprice) t from {HOUSEHOLDS} group by 1) select n_regionkey, round(sum(o_totalprice / t), 9) total, abs(sum(o_totalprice / t) - 1) < 1e-9 holds from {HOUSEHOLDS} join t using (n_regionkey) group by 1")
def q11_weight_totals(t):
    weighted = W.equal_group_weights(t.households, "n_regionkey", "o_totalprice")
    failing = K.weight_totals(weighted, "n_regionkey", "w", 1.0).select("n_regionkey", F.lit(False).alias("holds"))
    totals = weighted.groupBy("n_regionkey").agg(F.round(F.sum("w"), 9).alias("total"))
    return totals.join(failing, "n_regionkey", "left").withColumn("holds", F.coalesce("holds", F.lit(True)))


@query("select o_custkey, count(*) n from orders group by 1 having count(*) < 5")
def q12_small_cells(t):
    return t.orders.groupBy("o_custkey").agg(n_rows()).where("n < 5")


# sources


@query("select o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 2) o_totalprice from orders")
def s4_fixed_width_layers(t):
    """Orders written as compressed fixed-width text, read back, cut into raw fields and typed."""
    layout = [("o_orderkey", 1, 12, "bigint"), ("o_custkey", 13, 24, "bigint"), ("o_orderstatus", 25, 26, "string"), ("o_totalprice", 27, 42, "double")]
    folder = new_folder(t.spark, "records")
    X.to_lines(t.orders.withColumn("o_totalprice", F.round("o_totalprice", 2)), layout).write.text(folder, compression="gzip")
    return X.typed_layer(X.raw_layer(t.spark.read.text(folder), layout), layout)


@query("select length(props)::INT as length, count(*) n_lines, count(*) filter (where regexp_matches(props, '[^\\x00-\\x7F]')) n_non_ascii from events group by 1")
def s6_line_lengths(t):
    """The lengths of the records of a text column."""
    return X.line_lengths(t.events, "props")


@query()
def s13_manifest(t):
    return T.manifest({"orders": t.orders, "customer": t.customer}, product="example")


# reports and grids


@query("select o_orderpriority, f, o, p from (select o_orderpriority, format('{} ({})', count(*) filter (o_orderstatus = 'F'), count(distinct o_custkey) filter (o_orderstatus = 'F')) f, format('{} ({})', count(*) filter (o_orderstatus = 'O'), count(distinct o_custkey) filter (o_orderstatus = 'O')) o, format('{} ({})', count(*) filter (o_orderstatus = 'P'), count(distinct o_custkey) filter (o_orderstatus = 'P')) p from orders group by 1)")
def r1_wide_cells(t):
    cells = t.orders.groupBy("o_orderpriority", "o_orderstatus").agg(F.format_string("%d (%d)", F.count(F.lit(1)), F.countDistinct("o_custkey")).alias("cell"))
    return cells.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.first("cell")).select("o_orderpriority", c("F").alias("f"), c("O").alias("o"), c("P").alias("p"))


@query(f"select coalesce(n_regionkey::VARCHAR, 'ALL') n_regionkey, count(*) n, count(distinct o_custkey) clusters from {UNITS} group by grouping sets ((n_regionkey), ())")
def g11_sample_flow(t):
    return A.with_pooled(t.units, "n_regionkey", [n_rows(), F.countDistinct("o_custkey").alias("clusters")])
