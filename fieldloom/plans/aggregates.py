"""Queries of aggregates, weights and windows: A1 to A34, W2 to W10."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldloom.operators import aggregates as A
from fieldloom.operators import quantiles as N
from fieldloom.operators import recode as R
from fieldloom.operators import two_way as V
from fieldloom.operators import weights as W

from .base import HOUSEHOLDS, UNITS, n_rows, query

c = F.col


@query("select l_returnflag, count(*) n, count(*) filter (where l_quantity > 25) n_large, count(*) filter (where l_discount = 0) n_plain from lineitem group by 1")
def a1_conditional_counts(t):
    return t.lineitem.groupBy("l_returnflag").agg(n_rows(), F.count_if(c("l_quantity") > 25).alias("n_large"), F.count_if(c("l_discount") == 0).alias("n_plain"))


@query("select case when o_orderstatus <> 'P' then o_orderstatus end status, count(*) n from orders group by 1")
def a2_frequency_with_missing(t):
    return t.orders.groupBy(F.when(c("o_orderstatus") != "P", c("o_orderstatus")).alias("status")).agg(n_rows())


@query("select o_custkey, count(*) n, round(sum(o_totalprice), 2) total, round(avg(o_totalprice), 7) mean, min(o_totalprice) low, round(median(o_totalprice), 4) middle, max(o_totalprice) high from orders group by 1")
def a3_group_summary(t):
    x = "o_totalprice"
    return t.orders.groupBy("o_custkey").agg(n_rows(), F.round(F.sum(x), 2).alias("total"), F.round(F.avg(x), 7).alias("mean"), F.min(x).alias("low"), F.round(F.median(x), 4).alias("middle"), F.max(x).alias("high"))


@query("select o_custkey, count(distinct s) n_known, count(distinct s) + max((s is null)::INT)::BIGINT n_with_missing from (select o_custkey, case when o_orderstatus <> 'P' then o_orderstatus end s from orders) group by 1")
def a4_distinct_counts(t):
    s = F.when(c("o_orderstatus") != "P", c("o_orderstatus"))
    return t.orders.select("o_custkey", s.alias("s")).groupBy("o_custkey").agg(F.countDistinct("s").alias("n_known"), (F.countDistinct("s") + F.max(c("s").isNull().cast("int"))).alias("n_with_missing"))


@query(f"with p as (select n_regionkey, o_orderstatus, count(*) n, sum(o_totalprice) w from {HOUSEHOLDS} group by 1, 2) select n_regionkey, o_orderstatus, n, round(100 * w / sum(w) over (partition by n_regionkey), 8) share from p")
def a5_weighted_shares(t):
    out = A.weighted_shares(t.households, "o_orderstatus", c("o_totalprice"), ["n_regionkey"])
    return out.withColumn("share", F.round("share", 8))


@query("select l_returnflag, round(sum(l_quantity * l_discount) / sum(l_quantity), 8) mean, round(sqrt(sum(l_quantity * l_discount * l_discount) / sum(l_quantity) - (sum(l_quantity * l_discount) / sum(l_quantity)) ** 2), 8) sd from lineitem group by 1")
def a6_weighted_mean_sd(t):
    x, w = c("l_discount"), c("l_quantity")
    return t.lineitem.groupBy("l_returnflag").agg(F.round(A.weighted_mean(x, w), 8).alias("mean"), F.round(A.weighted_sd(x, w), 8).alias("sd"))


@query(f"select n_regionkey, round(sum(o_totalprice) filter (o_orderstatus = 'F') / sum(o_totalprice) filter (o_orderstatus in ('F', 'O')), 8) prevalence from {HOUSEHOLDS} group by 1")
def a7_prevalence(t):
    y = F.when(c("o_orderstatus") == "F", 1).when(c("o_orderstatus") == "O", 0)
    return t.households.groupBy("n_regionkey").agg(F.round(A.weighted_mean(y, c("o_totalprice")), 8).alias("prevalence"))


Q = [0, 0.01, 0.05, 0.5, 0.95, 0.99, 1]


@query("select o_orderpriority, " + ", ".join(f"round(quantile_cont(o_totalprice, {q}), 4) q{i}" for i, q in enumerate(Q)) + " from orders group by 1")
def a8_quantiles(t):
    out = N.quantiles(t.orders, "o_totalprice", list(map(float, Q)), "o_orderpriority")
    return out.select("o_orderpriority", *[F.round(c("q")[i], 4).alias(f"q{i}") for i in range(len(Q))])


@query("select l_shipmode, n, mean, sd, p90 from (select l_linestatus l_shipmode, count(l_tax) n, round(avg(l_tax), 8) mean, round(stddev_samp(l_tax), 8) sd, round(quantile_cont(l_tax, 0.9), 8) p90 from lineitem group by 1)")
def a9_describe(t):
    rows = t.lineitem.select(c("l_linestatus").alias("l_shipmode"), "l_tax")
    plain = rows.groupBy("l_shipmode").agg(F.count("l_tax").alias("n"), F.round(F.avg("l_tax"), 8).alias("mean"), F.round(F.stddev_samp("l_tax"), 8).alias("sd"))
    return plain.join(N.quantiles(rows, "l_tax", [0.9], "l_shipmode").drop("n"), "l_shipmode").select("l_shipmode", "n", "mean", "sd", F.round(c("q")[0], 8).alias("p90"))


@query("select l_returnflag, round(stddev_samp(l_extendedprice), 4) sample, round(stddev_pop(l_extendedprice), 4) population, max(abs(l_discount - l_tax)) gap from lineitem group by 1")
def a10_deviations(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.round(F.stddev_samp("l_extendedprice"), 4).alias("sample"), F.round(F.stddev_pop("l_extendedprice"), 4).alias("population"), F.max(F.abs(c("l_discount") - c("l_tax"))).alias("gap"))


STATES = ["F", "O", "P"]


@query("select o_custkey, " + ", ".join(f"round(min(o_totalprice) filter (o_orderstatus = '{s}'), 2) {s.lower()}" for s in STATES) + " from orders group by 1")
def a11_pivot(t):
    wide = t.orders.groupBy("o_custkey").pivot("o_orderstatus", STATES).agg(F.round(F.min("o_totalprice"), 2))
    return wide.select("o_custkey", *[c(s).alias(s.lower()) for s in STATES])


@query("with w as (select o_custkey, count(*) filter (o_orderstatus = 'F') > 0 f, count(*) filter (o_orderstatus = 'O') > 0 o, count(*) filter (o_orderstatus = 'P') > 0 p from orders group by 1) select f, o, p, count(*) n from w group by 1, 2, 3")
def a12_patterns(t):
    wide = t.orders.groupBy("o_custkey").agg(*[(F.count_if(c("o_orderstatus") == s) > 0).alias(s.lower()) for s in STATES])
    return wide.groupBy("f", "o", "p").agg(n_rows())


@query(f"select coalesce(n_regionkey::VARCHAR, 'ALL') n_regionkey, count(*) n, round(avg(o_totalprice), 7) mean from {HOUSEHOLDS} group by grouping sets ((n_regionkey), ())")
def a13_grouping_sets(t):
    return A.with_pooled(t.households, "n_regionkey", [n_rows(), F.round(F.avg("o_totalprice"), 7).alias("mean")])


@query("select l_linestatus level, count(*) n, round(100.0 * count(case when l_quantity > 10 then 1 end) / count(*), 8) known from lineitem group by 1")
def a14_availability(t):
    return t.lineitem.groupBy(c("l_linestatus").alias("level")).agg(n_rows(), F.round(100 * F.count(F.when(c("l_quantity") > 10, 1)) / F.count(F.lit(1)), 8).alias("known"))


NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" union all ".join(f"select '{a}' a, '{b}' b, round(corr({a}, {b}), 8) r from lineitem" for i, a in enumerate(NUM) for b in NUM[i + 1 :]))
def a15_correlations(t):
    return A.correlations(t.lineitem, NUM).select("a", "b", F.round("r", 8).alias("r"))


@query("""select o_custkey, '{' || string_agg('"' || o_orderstatus || '":' || n, ',' order by o_orderstatus) || '}' counts from (select o_custkey, o_orderstatus, count(*) n from orders group by 1, 2) group by 1""")
def a16_counter_map(t):
    return A.value_counts_json(t.orders, "o_custkey", "o_orderstatus")


@query(f"with k as (select c_nationkey, o_custkey, max((o_orderstatus = 'P')::INT) any_p from {HOUSEHOLDS} group by 1, 2), n as (select c_nationkey, avg(any_p) m from k group by 1) select round(avg(m), 8) mean, round(stddev_samp(m), 8) sd, round(min(m), 8) low, round(max(m), 8) high from n")
def a17_two_level(t):
    households = t.households.groupBy("c_nationkey", "o_custkey").agg(F.max((c("o_orderstatus") == "P").cast("int")).alias("any_p"))
    clusters = households.groupBy("c_nationkey").agg(F.avg("any_p").alias("m"))
    return clusters.agg(F.round(F.avg("m"), 8).alias("mean"), F.round(F.stddev_samp("m"), 8).alias("sd"), F.round(F.min("m"), 8).alias("low"), F.round(F.max("m"), 8).alias("high"))


@query(f"with k as (select n_regionkey, o_custkey, count(*) filter (where o_totalprice > 200000) high, count(*) filter (where o_orderstatus = 'P') partial from {HOUSEHOLDS} group by 1, 2) select n_regionkey, sum(high)::BIGINT events_high, count(*) filter (where high = 0) without_high, sum(partial)::BIGINT events_partial, count(*) filter (where partial = 0) without_partial from k group by 1")
def a22_event_counts(t):
    """Events of two outcomes by region, and the clusters without any."""
    events = {"high": c("o_totalprice") > 200000, "partial": c("o_orderstatus") == "P"}
    clusters = t.households.groupBy("n_regionkey", "o_custkey").agg(*[F.count_if(v).alias(k) for k, v in events.items()])
    return clusters.groupBy("n_regionkey").agg(*[x for k in events for x in (F.sum(k).alias(f"events_{k}"), F.count_if(c(k) == 0).alias(f"without_{k}"))])


@query("select variable, level, count(*) n, round(avg(o_totalprice), 7) mean, round(stddev_samp(o_totalprice), 4) sd from (select 'o_orderpriority' variable, o_orderpriority as level, o_totalprice from orders union all select 'o_orderstatus', o_orderstatus, o_totalprice from orders) group by 1, 2")
def a23_means_by_level(t):
    return A.by_each(t.orders, ["o_orderpriority", "o_orderstatus"], [n_rows(), F.round(F.avg("o_totalprice"), 7).alias("mean"), F.round(F.stddev_samp("o_totalprice"), 4).alias("sd")])


@query("select round(median(n), 4) middle, max(n) high, count(*) clusters from (select o_custkey, count(*) n from orders group by 1)")
def a24_size_distribution(t):
    return t.orders.groupBy("o_custkey").agg(n_rows()).agg(F.round(F.median("n"), 4).alias("middle"), F.max("n").alias("high"), F.count(F.lit(1)).alias("clusters"))


@query("select count(*) filter (where d = 0) zero, count(*) filter (where d = 1) one, count(*) filter (where d = 2) two, count(*) filter (where d < 0) negative, count(*) filter (where d > 2) more from (select l_linenumber - l_quantity::INT % 5 d from lineitem)")
def a25_difference_distribution(t):
    d = c("l_linenumber") - c("l_quantity").cast("int") % 5
    return t.lineitem.agg(F.count_if(d == 0).alias("zero"), F.count_if(d == 1).alias("one"), F.count_if(d == 2).alias("two"), F.count_if(d < 0).alias("negative"), F.count_if(d > 2).alias("more"))


@query(f"with k as (select n_regionkey, count(*) s, count(*) filter (where o_orderstatus <> 'P') a, count(*) filter (where o_orderstatus <> 'P' and o_totalprice > 1000) b from {HOUSEHOLDS} group by 1) select n_regionkey, unnest([0, 1, 2]) step, unnest(['start', 'outcome', 'exposure']) as name, unnest([s, a, b]) as left, unnest([0, s - a, a - b]) excluded from k".replace(" as left", ' as "left"'))
def a26_exclusion_cascade(t):
    return A.cascade(t.households, [("outcome", c("o_orderstatus") != "P"), ("exposure", c("o_totalprice") > 1000)], ["n_regionkey"])


#: Windows as months after the order, the months that are covered, and the shifts of the order's and the shipping month.
LAGS = {"before_3": (-3, -1), "order_month": (0, 0), "after_1": (1, 1), "after_2": (1, 2)}
COVERED = (1992 * 12 + 6, 1998 * 12 + 6)
MONTH_SHIFTS = {"order_plus_1": {"ordered": 1}, "ship_minus_1": {"shipped": -1}, "ship_plus_1": {"shipped": 1}}


def _lag_status(lag, ordered, shipped):
    """The first rule that holds decides: missing dates, months out of cover, a window that ends after the shipping month."""
    first, last = ordered + lag[0], ordered + lag[1]
    return R.first_match([(ordered.isNull() | shipped.isNull(), "missing"), ((first < COVERED[0]) | (last > COVERED[1]), "uncovered"), (last >= shipped, "incomplete")], "eligible")


_LAG_SQL = "case when b is null or t is null then 'missing' when b + {db} + lo < {c[0]} or b + {db} + hi > {c[1]} then 'uncovered' when b + {db} + hi >= t + {dt} then 'incomplete' else 'eligible' end = 'eligible'"


@query(
    f"""with u as (select n_regionkey, year(o_orderdate) * 12 + month(o_orderdate) b, year(l_shipdate) * 12 + month(l_shipdate) t from {UNITS}),
    w("window", lo, hi) as (values {", ".join(f"('{k}', {a}, {b})" for k, (a, b) in LAGS.items())}), s(shift, db, dt) as (values {", ".join(f"('{k}', {m.get('ordered', 0)}, {m.get('shipped', 0)})" for k, m in MONTH_SHIFTS.items())}),
    e as (select n_regionkey, "window", shift, {_LAG_SQL.format(db=0, dt=0, c=COVERED)} base, {_LAG_SQL.format(db="db", dt="dt", c=COVERED)} moved from u, w, s)
    select n_regionkey, "window", shift, count(*) filter (where base) eligible_base, count(*) filter (where moved) eligible_shifted, count(*) filter (where moved and not base) gained, count(*) filter (where base and not moved) lost from e group by 1, 2, 3"""
)
def a27_shift_sensitivity(t):
    """Eligibility of each window under three shifts of a month, by region."""
    month = lambda x: F.year(x) * 12 + F.month(x)
    return A.shift_sensitivity(t.units, _lag_status, {"ordered": month("o_orderdate"), "shipped": month("l_shipdate")}, LAGS, MONTH_SHIFTS, ["n_regionkey"])


@query("select count(*) filter (where a + b + c > 0) any_flag, count(*) filter (where a + b + c = 3) all_flags, count(*) filter (where a + b + c = 1) one_flag, count(*) filter (where a = 1 and b = 1) ab from (select (l_quantity > 40)::INT a, (l_discount > 0.08)::INT b, (l_tax > 0.06)::INT c from lineitem)")
def a28_flag_cooccurrence(t):
    flags = [(c(x) > v).cast("int") for x, v in (("l_quantity", 40), ("l_discount", 0.08), ("l_tax", 0.06))]
    total = flags[0] + flags[1] + flags[2]
    return t.lineitem.agg(F.count_if(total > 0).alias("any_flag"), F.count_if(total == 3).alias("all_flags"), F.count_if(total == 1).alias("one_flag"), F.count_if((flags[0] == 1) & (flags[1] == 1)).alias("ab"))


@query("select count(*) filter (where abs(l_extendedprice - 50000) <= 500) near, count(*) filter (where l_extendedprice > 50000) beyond from lineitem")
def a29_threshold_proximity(t):
    return t.lineitem.agg(F.count_if(F.abs(c("l_extendedprice") - 50000) <= 500).alias("near"), F.count_if(c("l_extendedprice") > 50000).alias("beyond"))


@query("select variable, level, count(*) n, round(100.0 * count(*) filter (where q <= 5) / count(*), 8) missing_share from (select 'l_returnflag' variable, l_returnflag as level, l_quantity q from lineitem union all select 'l_linestatus', l_linestatus, l_quantity from lineitem) group by 1, 2")
def a30_missing_by_group(t):
    return A.by_each(t.lineitem, ["l_returnflag", "l_linestatus"], [n_rows(), F.round(100 * F.count_if(c("l_quantity") <= 5) / F.count(F.lit(1)), 8).alias("missing_share")])


@query("select bool_and(not (l_quantity > 30) or l_quantity > 20) superset, count(*) filter (where l_quantity > 20 and not l_quantity > 30) boundary from lineitem")
def a31_superset_check(t):
    small, large = c("l_quantity") > 30, c("l_quantity") > 20
    return t.lineitem.agg(F.bool_and(~small | large).alias("superset"), F.count_if(large & ~small).alias("boundary"))


@query("select case when every_one then 'all' when some_one then 'some' else 'none' end agreement, count(*) n from (select l_orderkey, bool_and(l_quantity > 15) every_one, bool_or(l_quantity > 15) some_one from lineitem group by 1) group by 1")
def a32_candidate_agreement(t):
    ok = c("l_quantity") > 15
    units = t.lineitem.groupBy("l_orderkey").agg(F.bool_and(ok).alias("every_one"), F.bool_or(ok).alias("some_one"))
    return units.groupBy(F.when(c("every_one"), "all").when(c("some_one"), "some").otherwise("none").alias("agreement")).agg(n_rows())


@query("with k as (select o_orderpriority, year(o_orderdate)::INT y, count(*) n from orders group by 1, 2), r as (select *, row_number() over (partition by o_orderpriority order by n desc, y) i, sum(n) over (partition by o_orderpriority) total from k) select o_orderpriority, y mode, (total - n)::BIGINT unexplained from r where i = 1")
def a33_modal_value(t):
    counts = t.orders.groupBy("o_orderpriority", F.year("o_orderdate").alias("y")).agg(n_rows())
    best = counts.groupBy("o_orderpriority").agg(F.max(F.struct("n", (-c("y")).alias("y"))).alias("b"), F.sum("n").alias("total"))
    return best.select("o_orderpriority", (-c("b.y")).alias("mode"), (c("total") - c("b.n")).alias("unexplained"))


@query("select count(*) filter (where month(l_shipdate) <> month(o_orderdate)) n_month, count(*) n from lineitem join orders on l_orderkey = o_orderkey")
def a34_month_disagreement(t):
    both = t.lineitem.join(t.orders, c("l_orderkey") == c("o_orderkey"))
    return both.agg(F.count_if(F.month("l_shipdate") != F.month("o_orderdate")).alias("n_month"), n_rows())


@query(f"select o_orderkey, round(o_totalprice / sum(o_totalprice) over (partition by n_regionkey), 14) w from {HOUSEHOLDS}")
def w2_equal_group_weights(t):
    return W.equal_group_weights(t.households, "n_regionkey", "o_totalprice").select("o_orderkey", F.round("w", 14).alias("w"))


@query(f"select o_orderkey, round(o_totalprice / sum(o_totalprice) over (partition by n_regionkey) * (select count(*) / count(distinct n_regionkey) from {HOUSEHOLDS}), 9) w from {HOUSEHOLDS}")
def w3_scaled_group_weights(t):
    return W.equal_group_weights(t.households, "n_regionkey", "o_totalprice", scaled=True).select("o_orderkey", F.round("w", 9).alias("w"))


@query(f"select l_orderkey, l_partkey, l_linenumber, round(l_discount - sum(l_quantity * l_discount) over k / sum(l_quantity) over k, 12) + 0.0 d from {UNITS} window k as (partition by o_custkey)")
def w4_weighted_demeaning(t):
    return W.demean(t.units, "o_custkey", ["l_discount"], c("l_quantity")).select("l_orderkey", "l_partkey", "l_linenumber", (F.round("l_discount", 12) + F.lit(0.0)).alias("d"))


@query("select o_orderkey, round(o_totalprice - avg(o_totalprice) over (partition by o_custkey), 7) + 0.0 d from orders")
def w5_demeaning(t):
    return W.demean(t.orders, "o_custkey", ["o_totalprice"]).select("o_orderkey", (F.round("o_totalprice", 7) + F.lit(0.0)).alias("d"))


@query("select o_orderkey from (select o_orderkey, count(*) over (partition by o_custkey) n from orders) where n >= 2")
def w6_drop_singletons(t):
    return W.drop_singletons(t.orders, "o_custkey").select("o_orderkey")


@query("select o_orderkey, (row_number() over (partition by o_custkey order by o_orderkey) - 1)::INT i from orders")
def w7_running_index(t):
    return t.orders.select("o_orderkey", (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).alias("i"))


@query("select o_orderkey, date_diff('day', lag(o_orderdate) over (partition by o_custkey order by o_orderdate, o_orderkey), o_orderdate)::INT as days from orders")
def w8_lag_span(t):
    before = F.lag("o_orderdate").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return t.orders.select("o_orderkey", F.date_diff("o_orderdate", before).alias("days"))


def two_way_sql(rows: str, passes: int) -> str:
    """The means m of cells (part, g, y, n, m) after so many passes, as r: the passes one after the other."""
    steps = ["r0 as (" + rows + ")"]
    for i in range(2 * passes):
        own = "part, g" if i % 2 == 0 else "part, y"
        steps.append(f"r{i + 1} as (select part, g, y, n, m - sum(n * m) over p / sum(n) over p m from r{i} window p as (partition by {own}))")
    return ", ".join(steps) + f", r as (select * from r{2 * passes})"


@query(
    "with o as (select o_orderkey, o_custkey g, year(o_orderdate) y, o_totalprice x from orders), " + two_way_sql("select 0 part, g, y, count(*) n, avg(x) m from o group by g, y", 25)
    + " select o_orderkey, round(x - avg(x) over (partition by g, y) + m, 4) + 0.0 d from o join r using (g, y)"
)
def w9_two_way_demeaning(t):
    """25 passes over customers and years, on the cells of both."""
    rows = V.demean_two_way(t.orders.select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("y"), "o_totalprice"), "o_custkey", "y", "o_totalprice")
    return rows.select("o_orderkey", (F.round("o_totalprice", 4) + F.lit(0.0)).alias("d"))


@query(f"with k as (select n_regionkey, n_name, count(*) n from {HOUSEHOLDS} group by 1, 2) select n_regionkey, n_name, round(100.0 * n / sum(n) over (partition by n_regionkey), 8) share from k")
def w10_share_of_parent(t):
    counts = t.households.groupBy("n_regionkey", "n_name").agg(n_rows())
    return counts.select("n_regionkey", "n_name", F.round(100 * c("n") / F.sum("n").over(Window.partitionBy("n_regionkey")), 8).alias("share"))
