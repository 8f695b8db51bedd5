"""Queries of sources, sinks, contracts, functions and reports: S1 to S16, Q1 to Q15, F6 to F17, E11 to E15, R2 to R8."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from fieldloom.functions import calendar as C
from fieldloom.operators import contracts as K
from fieldloom.operators import joins as J
from fieldloom.operators import regress as G
from fieldloom.operators import survey as S
from fieldloom.sources import tables as T
from fieldloom.sources.tables import new_folder

from . import spatial
from .base import HOUSEHOLDS, UNITS, n_rows, query
from .estimates import interval_sql

c = F.col
REGION_MEANS = f"""
    with r as (select n_regionkey, c_nationkey s, o_custkey c, o_totalprice / 1000 w, (o_orderstatus = 'F')::INT y from {HOUSEHOLDS}), k as (select n_regionkey, s, c, sum(w) w, sum(w * y) wy, count(*) n from r group by 1, 2, 3),
    t as (select n_regionkey, sum(wy) / sum(w) m, sum(w) ww from k group by 1), z as (select n_regionkey, s, (wy - m * w) / ww z, n, m from k join t using (n_regionkey)),
    v as (select n_regionkey, s, count(*) k, var_samp(z) v, sum(n) n, first(m) m from z group by 1, 2)
    select n_regionkey, first(m) mean, sqrt(sum(k * v)) se, (sum(k) - count(*))::BIGINT df, sum(n)::BIGINT n from v group by 1"""


@query("select o_orderkey, o_totalprice from orders")
def s1_pruned_scan(t):
    return T.read_table(t.spark, f"{t.sf_dir}/orders.parquet", ["o_orderkey", "o_totalprice"])


@query("select c_custkey, c_nationkey, n_name c_nationkey_label from customer left join nation on c_nationkey = n_nationkey")
def s3_label_decode(t):
    labels = t.nation.select(F.lit("c_nationkey").alias("variable"), c("n_nationkey").alias("code"), c("n_name").alias("label"))
    return T.decode(t.customer.select("c_custkey", "c_nationkey"), "c_nationkey", labels, "c_nationkey")


@query("select count(*) n, count(try_cast(nullif(trim(substr(p_brand, 7)), '') as INT)) n_brand, count(*) filter (where trim(p_type) <> '' and try_cast(trim(p_type) as INT) is null) type_failures, count(*) filter (where trim(substr(p_brand, 7)) <> '' and try_cast(trim(substr(p_brand, 7)) as INT) is null) brand_failures from part")
def s5_typed_layer(t):
    typed = lambda x: F.nullif(F.trim(x), F.lit("")).try_cast("int")
    failed = lambda x: F.count_if((F.trim(x) != "") & typed(x).isNull())
    brand = F.substring("p_brand", 7, 20)
    return t.part.agg(n_rows(), F.count(typed(brand)).alias("n_brand"), failed(c("p_type")).alias("type_failures"), failed(brand).alias("brand_failures"))


@query("select o_orderkey, o_totalprice, o_orderpriority from orders")
def s9_csv_round_trip(t):
    path = new_folder(t.spark, "csv")
    T.write_csv(t.orders.select("o_orderkey", "o_totalprice", "o_orderpriority"), path)
    return T.read_csv(t.spark, path, "o_orderkey long, o_totalprice double, o_orderpriority string")


@query("select l_orderkey, l_linenumber, l_quantity from lineitem")
def s10_parquet_round_trip(t):
    """Written once to a new folder (s11: a second write there fails) and read back."""
    path = new_folder(t.spark, "parquet")
    T.write_once(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity"), path)
    return t.spark.read.parquet(path)


@query("select o_orderpriority, n::VARCHAR n, 0 row_order from (select o_orderpriority, count(*) n from orders group by 1) union all select 'orders by priority', null, 1")
def s12_report_with_notes(t):
    return T.with_notes(t.orders.groupBy("o_orderpriority").agg(n_rows()), "orders by priority")


@query("select count(*) n, count(*) n_with_source, 1::BIGINT n_times from orders")
def s14_provenance(t):
    return T.with_provenance(t.orders).agg(n_rows(), F.count("source_file").alias("n_with_source"), F.countDistinct("read_at").alias("n_times"))


@query(f"with {spatial.CLUSTERS} select unnest(['missing', 'out_of_range', 'zero_zero', 'one_zero', 'duplicate_key']) contract, unnest([count(*) filter (where lat is null or lon is null), count(*) filter (where abs(lat) > 90 or abs(lon) > 180), count(*) filter (where lat = 0 and lon = 0), count(*) filter (where (lat = 0) <> (lon = 0)), count(*) - count(distinct cluster)]) violations from m")
def s16_cluster_attributes(t):
    df = spatial.clusters(t)
    lat, lon = c("lat"), c("lon")
    checks = K.rules(df, {"missing": lat.isNull() | lon.isNull(), "out_of_range": (F.abs(lat) > 90) | (F.abs(lon) > 180), "zero_zero": (lat == 0) & (lon == 0), "one_zero": (lat == 0) != (lon == 0)})
    repeated = df.groupBy("cluster").agg(n_rows()).agg(F.lit("duplicate_key").alias("contract"), F.coalesce(F.sum(c("n") - 1), F.lit(0)).alias("violations"))
    return checks.unionByName(repeated)


@query("select count(*) n_rows, true AS same from orders")
def q1_content_fingerprint(t):
    """The table's fingerprint does not depend on the order and place of its rows."""
    prints = lambda df: df.agg(F.count(F.lit(1)).alias("n_rows"), T.fingerprint(df))
    a, b = prints(t.orders), prints(t.orders.repartition("o_custkey"))
    return a.join(b.withColumnRenamed("fingerprint", "again"), "n_rows").select("n_rows", (c("fingerprint") == c("again")).alias("same"))


@query("select count(*) n, count(*) filter (where l_returnflag is distinct from l_linestatus) n_differ from lineitem")
def q8_columns_identical(t):
    return t.lineitem.agg(n_rows(), F.count_if(~c("l_returnflag").eqNullSafe(c("l_linestatus"))).alias("n_differ"))


@query("select unnest(['price_positive', 'price_finite', 'quantity_range', 'discount_range']) contract, unnest([count(*) filter (where l_extendedprice <= 0), count(*) filter (where isnan(l_extendedprice) or isinf(l_extendedprice)), count(*) filter (where l_quantity not between 1 and 50), count(*) filter (where l_discount not between 0 and 0.05)]) violations from lineitem")
def q10_ranges(t):
    price = c("l_extendedprice")
    return K.rules(t.lineitem, {"price_positive": price <= 0, "price_finite": F.isnan(price) | (F.abs(price) == float("inf")), "quantity_range": ~c("l_quantity").between(1, 50), "discount_range": ~c("l_discount").between(0, 0.05)})


@query(f"with g as (select n_regionkey, n_name, count(*) n, sum(o_totalprice) total from {HOUSEHOLDS} group by 1, 2) select unnest(['unique_key', 'no_missing', 'parts_sum_to_total', 'nested_levels']) AS check, unnest([count(*) = count(distinct (n_regionkey, n_name)), count(*) = count(total), sum(n) = (select count(*) from orders), count(distinct n_name) = count(*)]) passed, unnest([count(*), count(total), sum(n)::BIGINT, count(distinct n_name)]) detail from g")
def q13_result_integrity(t):
    g = t.households.groupBy("n_regionkey", "n_name").agg(n_rows(), F.sum("o_totalprice").alias("total"))
    one = g.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("n_regionkey", "n_name").alias("keys"), F.count("total").alias("known"), F.sum("n").alias("parts"), F.countDistinct("n_name").alias("names"))
    check = lambda name, passed, detail: F.struct(F.lit(name).alias("check"), passed.alias("passed"), c(detail).alias("detail"))
    return one.select(F.inline(F.array(
        check("unique_key", c("rows") == c("keys"), "rows"), check("no_missing", c("rows") == c("known"), "known"),
        check("parts_sum_to_total", c("parts") == F.lit(t.orders.count()), "parts"), check("nested_levels", c("names") == c("rows"), "names"),
    )))


@query(f"with u as (select * from {UNITS}) select count(*) n, count(*) filter (where l_extendedprice is null) missing_outcome, count(*) filter (where o_orderstatus = 'P') missing_exposure, count(*) filter (where l_discount is null or l_tax is null) missing_controls, bool_or(n_regionkey = 0) reference_present, (select count(*) from (select o_custkey from u group by 1 having count(distinct n_regionkey) > 1)) clusters_across_regions from u")
def q15_pre_fit_checklist(t):
    u = t.units
    one = u.agg(
        n_rows(), F.count_if(c("l_extendedprice").isNull()).alias("missing_outcome"), F.count_if(c("o_orderstatus") == "P").alias("missing_exposure"),
        F.count_if(c("l_discount").isNull() | c("l_tax").isNull()).alias("missing_controls"), F.bool_or(c("n_regionkey") == 0).alias("reference_present"),
    )
    return one.withColumn("clusters_across_regions", F.lit(K.depends(u, "o_custkey", "n_regionkey").count()).cast("long"))


#: Days before each month in a common year.
MONTH_STARTS = [0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334]


@query("select o_orderkey, make_date(year(o_orderdate), month(o_orderdate), 1)::VARCHAR first_day, (make_date(year(o_orderdate), month(o_orderdate), 1) + 14)::VARCHAR middle_day, last_day(o_orderdate)::VARCHAR final_day, dayofyear(o_orderdate)::INT day_count from orders")
def f6_candidate_dates(t):
    """Three dates that a month may stand for, and the day of the year from cumulative month lengths."""
    first = F.trunc(c("o_orderdate").cast("date"), "month")
    month = F.month("o_orderdate")
    before = F.element_at(F.array(*[F.lit(n) for n in MONTH_STARTS]), month) + (C.is_leap(F.year("o_orderdate")) & (month > 2)).cast("int")
    return t.orders.select("o_orderkey", first.cast("string").alias("first_day"), F.date_add(first, 14).cast("string").alias("middle_day"), F.last_day(c("o_orderdate").cast("date")).cast("string").alias("final_day"), (before + F.dayofmonth("o_orderdate")).alias("day_count"))


@query("select l_orderkey, l_linenumber, l_quantity, round_even(l_quantity::DECIMAL(18,1) / 2, 0)::BIGINT halves from lineitem")
def f10_half_even(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", F.bround((c("l_quantity") / 2).cast("decimal(18,1)"), 0).cast("long").alias("halves"))


@query("select count(*) n, count(distinct (o_orderkey, o_custkey, o_totalprice)) n_hashes from orders")
def f11_row_hash(t):
    return t.orders.agg(n_rows(), F.countDistinct(F.xxhash64("o_orderkey", "o_custkey", "o_totalprice")).alias("n_hashes"))


@query("""select o_custkey, '{"n":' || count(*) || ',"filled":' || count(*) filter (where o_orderstatus = 'F') || '}' result from orders group by 1""")
def f16_json_results(t):
    return t.orders.groupBy("o_custkey").agg(F.to_json(F.struct(n_rows(), F.count_if(c("o_orderstatus") == "F").alias("filled"))).alias("result"))


@query("with k as (select o_orderkey, year(o_orderdate) - 8 y, month(o_orderdate) m, unnest(range(1, 31))::INT AS d from orders), g as (select *, date '0001-01-01' + (2796 + 365 * (y - 1) + y // 4 + 30 * (m - 1) + d - 2)::INT AS converted from k) select o_orderkey, bool_or(month(converted) = (m + 8 - 1) % 12 + 1) possible from g group by 1")
def f17_possible_month(t):
    """Whether some day of the other calendar's month falls in the Gregorian month eight later."""
    year, month = F.year("o_orderdate") - 8, F.month("o_orderdate")
    days = F.sequence(F.lit(1), F.lit(30))
    possible = F.exists(days, lambda d: F.month(C.other_to_gregorian(year, month, d)) == (month + 7) % 12 + 1)
    return t.orders.select("o_orderkey", possible.alias("possible"))


NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def centred(t) -> tuple[np.ndarray, int]:
    g, n = G.gram(t.lineitem.withColumns({"_one": F.lit(1.0)}), ["_one", *NUMBERS], "_one")
    return g[1:, 1:] - np.outer(g[0, 1:], g[0, 1:]) / g[0, 0], n


@query()
def e11_condition_number(t):
    g, n = centred(t)
    rank, scaled = G.scaled_rank(g)
    values = np.linalg.eigvalsh(g)
    return t.spark.createDataFrame([(float(np.sqrt(values[-1] / values[0])), scaled, rank, n)], "raw double, scaled double, rank int, n long")


def _minor(rows: tuple[int, ...], columns: tuple[int, ...]) -> str:
    """The determinant of a part of the correlation matrix, as SQL."""
    if not rows:
        return "1.0"
    rest = ((-1) ** k * 1.0 for k in range(len(columns)))
    return "(" + " + ".join(f"{sign} * {'1.0' if rows[0] == j else f'r{min(rows[0], j)}{max(rows[0], j)}'} * {_minor(rows[1:], columns[:k] + columns[k + 1 :])}" for (k, j), sign in zip(enumerate(columns), rest)) + ")"


_ALL = tuple(range(len(NUMBERS)))
_ON_OTHERS = {i: f"1 - {_minor(_ALL, _ALL)} / {_minor(_ALL[:i] + _ALL[i + 1 :], _ALL[:i] + _ALL[i + 1 :])}" for i in _ALL}


@query(
    f"with m as (select {', '.join(f'corr({NUMBERS[i]}, {NUMBERS[j]}) r{i}{j}' for i in _ALL for j in _ALL if i < j)} from lineitem), s as ("
    + " union all ".join(f"select '{NUMBERS[i]}' term, {x} r from m" for i, x in _ON_OTHERS.items()) + ") select term, round(r, 6) r_squared, r > 0.999999 dependent from s"
)
def e12_exact_dependence(t):
    """R squared of each column on all others."""
    g, _ = centred(t)
    return t.spark.createDataFrame([(x, round(float(r), 6), bool(r > 0.999999)) for x, r in zip(NUMBERS, G.dependence(g), strict=True)], "term string, r_squared double, dependent boolean")


@query("with s as (select stddev_pop(l_extendedprice) sd, corr(l_quantity, l_extendedprice) r from lineitem) select round(sd, 4) total_sd, round(sd * sqrt(1 - r * r), 4) residual_sd, round(1 - r * r, 6) share from s")
def e13_residual_variation(t):
    """What is left of an exposure after its control, by partial regression on the cross products."""
    g, n = centred(t)
    rest = g[1, 1] - g[0, 1] ** 2 / g[0, 0]
    return t.spark.createDataFrame([(round(float(np.sqrt(g[1, 1] / n)), 4), round(float(np.sqrt(rest / n)), 4), round(float(rest / g[1, 1]), 6))], "total_sd double, residual_sd double, share double")


@query()
def e15_equal_column_spaces(t):
    """Two codings of the regions (dummies less the first, less the last) span one space: each rank and that of both together."""
    rows = t.households.withColumns({f"d{i}": (c("n_regionkey") == i).cast("double") for i in range(5)}).withColumn("_one", F.lit(1.0))
    codings = {"first": ["_one", "d1", "d2", "d3", "d4"], "last": ["_one", "d0", "d1", "d2", "d3"], "both": ["_one", "d0", "d1", "d2", "d3", "d4"]}
    g, n = G.gram(rows, codings["both"], "_one")
    at = lambda names: [codings["both"].index(x) for x in names]
    ranks = {k: G.scaled_rank(g[np.ix_(at(v), at(v))])[0] for k, v in codings.items()}
    return t.spark.createDataFrame([(ranks["first"], ranks["last"], ranks["both"], len(set(ranks.values())) == 1, n)], "rank_first int, rank_last int, rank_both int, equal boolean, n long")


@query(f"select n_regionkey, n, printf('%.1f%% [%.1f, %.1f]', 100 * mean, 100 * low, 100 * high) cell from ({interval_sql(REGION_MEANS, 'n_regionkey, ')})")
def r2_prevalence_cells(t):
    """Design-based share of fulfilled orders by region as a cell with its interval."""
    rows = t.households.withColumn("w", c("o_totalprice") / 1000)
    out = S.design_proportion(rows, (c("o_orderstatus") == "F").cast("int"), "w", "c_nationkey", "o_custkey", ["n_regionkey"])
    return out.select("n_regionkey", "n", F.format_string("%.1f%% [%.1f, %.1f]", 100 * c("mean"), 100 * c("low"), 100 * c("high")).alias("cell"))


@query("select o_orderpriority, round_even(100 * count(*) / sum(count(*)) over (), 1) share from orders group by 1")
def r3_category_shares(t):
    counts = t.orders.groupBy("o_orderpriority").agg(n_rows())
    return counts.select("o_orderpriority", F.bround(100 * c("n") / F.lit(t.orders.count()), 1).alias("share"))


@query("select 'customers' panel, c_mktsegment item, count(*) n, round(avg(c_acctbal), 6) mean from customer group by 2 union all select 'orders', o_orderpriority, count(*), round(avg(o_totalprice), 6) from orders group by 2")
def r7_summary_stack(t):
    stack = lambda df, item, x: df.groupBy(c(item).alias("item")).agg(n_rows(), F.round(F.avg(x), 6).alias("mean"))
    return J.union_panels({"customers": stack(t.customer, "c_mktsegment", "c_acctbal"), "orders": stack(t.orders, "o_orderpriority", "o_totalprice")})


@query(f"with {spatial.CLUSTERS} select distinct round(lon, 6) lon, round(lat, 6) lat, radius from m")
def r8_cluster_coordinates(t):
    return spatial.clusters(t).select(F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), "radius").distinct()
