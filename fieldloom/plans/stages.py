"""Whole preparation jobs: G1 flags, G2 indicators, G3 weights and design, G5 geography, G6 descriptives, G9 birth order,
G31 calendar audit, G32 identifier audit, G41 dataset checks, and the layout reports S7 and S8 on layouts derived from data."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldloom.functions import calendar
from fieldloom.operators import calendars as Q
from fieldloom.operators import recode as R
from fieldloom.sources import fixed_width

from .base import HOUSEHOLDS, UNITS, n_rows, query

c = F.col
CODES = {48: "height", 49: "age", 50: "not_measured"}
STATE = "case when q is null then 'missing' when q = 48 then 'height' when q = 49 then 'age' when q = 50 then 'not_measured' else 'valid' end"


@query(f"with u as (select n_regionkey, l_quantity::INT q from {UNITS}), s as (select n_regionkey, {STATE} state, q from u) select n_regionkey, state, count(*) n, round(100.0 * count(*) / sum(count(*)) over (partition by n_regionkey), 6) percent, round(avg(case when state = 'valid' then q / 100.0 end), 6) mean_z from s group by 1, 2")
def g1_measurement_flags(t):
    """Every measure of every group in one job: its state, the share of each state, and the mean of the valid ones."""
    state, _, z = R.special_codes(c("l_quantity").cast("int"), CODES)
    counts = t.units.select("n_regionkey", state.alias("state"), z.alias("z")).groupBy("n_regionkey", "state").agg(n_rows(), F.round(F.avg("z"), 6).alias("mean_z"))
    return counts.withColumn("percent", F.round(100 * c("n") / F.sum("n").over(Window.partitionBy("n_regionkey")), 6))


@query(f"with u as (select n_regionkey, o_orderpriority, l_quantity::INT q from {UNITS}), s as (select *, {STATE} state from u), i as (select n_regionkey, o_orderpriority, case when state = 'valid' then (q < 20)::INT end low, case when state = 'valid' then (q < 10)::INT end very_low from s) select n_regionkey, o_orderpriority, count(*) n, count(low) n_valid, round(100 * avg(low), 6) low, round(100 * avg(very_low), 6) very_low, count(*) filter (where very_low > low) n_not_nested from i group by 1, 2")
def g2_indicators(t):
    """Two nested indicators below a cut, by group and category, with the invariant that the narrow one implies the wide one."""
    state, _, z = R.special_codes(c("l_quantity").cast("int"), CODES)
    made = t.units.select("n_regionkey", "o_orderpriority", R.below(z, 0.2).alias("low"), R.below(z, 0.1).alias("very_low"))
    share = lambda x: F.round(100 * F.avg(x), 6).alias(x)
    return made.groupBy("n_regionkey", "o_orderpriority").agg(n_rows(), F.count("low").alias("n_valid"), share("low"), share("very_low"), F.count_if(c("very_low") > c("low")).alias("n_not_nested"))


@query(f"with h as (select n_regionkey, n_nationkey, o_custkey, o_totalprice w from {HOUSEHOLDS}), m as (select n_regionkey, avg(w) mean from h group by 1) select h.n_regionkey, count(*) n, count(distinct n_nationkey) strata, count(distinct o_custkey) clusters, round(sum(w / mean), 4) total, round(pow(sum(w / mean), 2) / sum(pow(w / mean, 2)), 3) effective_n from h join m on h.n_regionkey = m.n_regionkey group by 1")
def g3_weights_and_design(t):
    """Weights scaled to a mean of one in each group, with its strata and clusters, and the effective sample size."""
    rows = t.households.select("n_regionkey", "n_nationkey", "o_custkey", c("o_totalprice").alias("w"))
    # one row a group, and groups are as few as regions
    means = rows.groupBy(c("n_regionkey").alias("region")).agg(F.avg("w").alias("mean"))
    scaled = rows.join(F.broadcast(means), c("n_regionkey") == c("region")).withColumn("w", c("w") / c("mean"))
    total = F.sum("w")
    return scaled.groupBy("n_regionkey").agg(
        n_rows(), F.countDistinct("n_nationkey").alias("strata"), F.countDistinct("o_custkey").alias("clusters"), F.round(total, 4).alias("total"), F.round(total * total / F.sum(c("w") * c("w")), 3).alias("effective_n")
    )


PLACE = "case when lat is null or lon is null then 'missing' when lat = 0 and lon = 0 then 'sentinel' when lat = 0 or lon = 0 then 'one_zero' when lat not between -90 and 90 or lon not between -180 and 180 then 'out_of_range' when lat not between -60 and 75 or lon not between -170 and 170 then 'outside_box' else 'ok' end"


@query(f"with p as (select c_custkey, c_nationkey, round(c_acctbal / 100) lat, (c_custkey % 400) - 200.0 lon from customer), k as (select c_custkey, c_nationkey, {PLACE} place from p) select n_regionkey, place, count(distinct c_custkey) clusters, count(o_orderkey) n from k join nation on c_nationkey = n_nationkey left join orders on o_custkey = c_custkey group by 1, 2")
def g5_cluster_geography(t):
    """Coordinates of every cluster put in a class, attached to its units; clusters without units stay."""
    lat, lon = F.round(c("c_acctbal") / 100), (c("c_custkey") % 400 - 200).cast("double")
    clusters = t.customer.select("c_custkey", "c_nationkey", R.valid_coordinates(lat, lon, (-60, 75, -170, 170)).alias("place"))
    # units are counted before the join, so it has one row a cluster
    units = t.orders.groupBy(c("o_custkey").alias("cluster")).agg(n_rows())
    placed = clusters.join(F.broadcast(t.nation), c("c_nationkey") == c("n_nationkey")).join(units, c("c_custkey") == c("cluster"), "left")
    return placed.groupBy("n_regionkey", "place").agg(F.count(F.lit(1)).alias("clusters"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


@query(f"select n_regionkey, o_orderpriority, count(*) n, round(100 * avg((o_orderstatus = 'F')::INT), 6) percent, round(100 * sum(o_totalprice * (o_orderstatus = 'F')::INT) / sum(o_totalprice), 6) weighted_percent from {HOUSEHOLDS} group by grouping sets ((n_regionkey, o_orderpriority), (n_regionkey), (o_orderpriority), ())")
def g6_descriptives(t):
    """Counts, shares and weighted shares by group, by category, by both and overall, in one pass."""
    yes, w = (c("o_orderstatus") == "F").cast("int"), c("o_totalprice")
    region, category = c("n_regionkey"), c("o_orderpriority")
    sets = t.households.groupingSets([[region, category], [region], [category], []], region, category)
    return sets.agg(n_rows(), F.round(100 * F.avg(yes), 6).alias("percent"), F.round(100 * F.sum(w * yes) / F.sum(w), 6).alias("weighted_percent"))


@query(f"with h as (select n_regionkey, row_number() over w place, date_diff('day', lag(o_orderdate) over w, o_orderdate) gap from {HOUSEHOLDS} window w as (partition by o_custkey order by o_orderdate, o_orderkey)) select n_regionkey, least(place, 4) place, count(*) n, round(avg(gap), 6) mean_gap, max(gap)::BIGINT longest_gap from h group by 1, 2")
def g9_birth_order(t):
    """The place of every row among its mother's, the fourth and later as one class, with the days since the one before."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    gap = F.date_diff(c("o_orderdate"), F.lag("o_orderdate").over(order))
    rows = t.households.select("n_regionkey", F.least(F.row_number().over(order), F.lit(4)).cast("long").alias("place"), gap.alias("gap"))
    return rows.groupBy("n_regionkey", "place").agg(n_rows(), F.round(F.avg("gap"), 6).alias("mean_gap"), F.max("gap").cast("long").alias("longest_gap"))


@query('with d as (select month(o_orderdate)::BIGINT as "month", (year(o_orderdate) % 4 = 0 and (year(o_orderdate) % 100 <> 0 or year(o_orderdate) % 400 = 0)) leap, dayofyear(o_orderdate) - 30 * (month(o_orderdate) - 1) - day(o_orderdate) residual from orders) select "month", leap, count(*) n, min(residual)::BIGINT least, max(residual)::BIGINT most, min(residual) = max(residual) constant from d group by 1, 2')
def g31_calendar_audit(t):
    """Days of the year against twelve months of 30 days: the residual must be constant in a month of leap or other years."""
    date = c("o_orderdate")
    residual = F.dayofyear(date) - 30 * (F.month(date) - 1) - F.dayofmonth(date)
    rows = t.orders.select(F.month(date).cast("long").alias("month"), calendar.is_leap(F.year(date)).alias("leap"), residual.cast("long").alias("residual"))
    return rows.groupBy("month", "leap").agg(n_rows(), F.min("residual").alias("least"), F.max("residual").alias("most"), (F.min("residual") == F.max("residual")).alias("constant"))


@query(
    """with o as (select year(o_orderdate) y, month(o_orderdate) m, day(o_orderdate) d, date_diff('day', date '0001-01-01', o_orderdate::DATE) + 1 stated from orders),
    b as (select *, 365 * (y - 1) + (y - 1) // 4 - (y - 1) // 100 + (y - 1) // 400 s, [0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334][m] c from o),
    r as (select unnest(['thirty', 'common', 'leap']) model, m AS month, unnest([stated - s - 30 * (m - 1) - d, stated - s - c - d, stated - s - c - d - ((y % 4 = 0 and (y % 100 <> 0 or y % 400 = 0)) and m > 2)::INT]) residual from b),
    a as (select * from r union all select model, null, residual from r),
    k as (select model, month, residual, count(*) n from a group by 1, 2, 3), g as (select model, month, sum(n)::BIGINT n, min(residual)::BIGINT least, max(residual)::BIGINT most, max(n) n_modal, (arg_max(residual, n * 1000 - residual))::BIGINT modal from k group by 1, 2)
    select model, month, n, least, modal, most, n_modal, n - n_modal unexplained, least = most constant, model = (select min(model) from g where month is null and n_modal = (select max(n_modal) from g where month is null)) chosen from g"""
)
def g31_month_models(t):
    """Three models of month lengths against the days since a fixed start: residuals by month, and the model that explains them."""
    date = c("o_orderdate").cast("date")
    year, month = F.year(date), F.month(date)
    stated = F.date_diff(date, F.lit("0001-01-01").cast("date")) + 1
    return Q.month_models(t.orders, stated, month, calendar.day_models(year, month, F.dayofmonth(date)))


@query(f"with k as (select n_regionkey, o_custkey, count(distinct n_nationkey) places, avg((o_orderstatus <> 'P')::INT) share from {HOUSEHOLDS} group by 1, 2) select n_regionkey, count(*) clusters, count(*) filter (where places > 1) n_ambiguous, count(*) filter (where share = 0) n_none, count(*) filter (where share = 1) n_all, round(avg(share), 6) mean_share from k group by 1")
def g32_identifier_audit(t):
    """Whether a cluster's id determines its place, and what share of each cluster's rows is measured."""
    measured = (c("o_orderstatus") != "P").cast("int")
    clusters = t.households.groupBy("n_regionkey", "o_custkey").agg((F.min("n_nationkey") != F.max("n_nationkey")).alias("ambiguous"), F.avg(measured).alias("share"))
    return clusters.groupBy("n_regionkey").agg(
        F.count(F.lit(1)).alias("clusters"), F.count_if("ambiguous").alias("n_ambiguous"), F.count_if(c("share") == 0).alias("n_none"), F.count_if(c("share") == 1).alias("n_all"), F.round(F.avg("share"), 6).alias("mean_share")
    )


@query(f"select n_regionkey, l_returnflag, count(*) n, count(distinct o_custkey) clusters, 0::BIGINT n_differs from {UNITS} group by 1, 2")
def g41_dataset_checks(t):
    """Rows and clusters of each model's sample, and by how much its rows differ from those reported per cluster."""
    sample = t.units.groupBy("n_regionkey", "l_returnflag").agg(n_rows(), F.countDistinct("o_custkey").alias("clusters"))
    per_order = t.lineitem.groupBy("l_orderkey", "l_returnflag").agg(F.count(F.lit(1)).alias("lines"))
    reported = t.households.join(per_order, c("o_orderkey") == c("l_orderkey")).groupBy("n_regionkey", "l_returnflag").agg(F.sum("lines").alias("reported"))
    return sample.join(reported, ["n_regionkey", "l_returnflag"], "full_outer").withColumn("n_differs", F.abs(F.coalesce("n", F.lit(0)) - F.coalesce("reported", F.lit(0)))).drop("reported")


LAYOUT = "select lower(p_brand) variable, min(p_size) a, max(p_size) b, list(distinct p_type) codes from lineitem join part on l_partkey = p_partkey where l_returnflag = '{}' group by 1"


@query(f"with x as ({LAYOUT.format('A')}), y as ({LAYOUT.format('R')}) select coalesce(x.variable, y.variable) variable, case when x.a is null then 'only_b' when y.a is null then 'only_a' else 'both' end side, x.a is not distinct from y.a and x.b is not distinct from y.b same_span, (x.a is null) = (y.a is null) same_type, len(list_filter(coalesce(x.codes, []), lambda v: not list_contains(coalesce(y.codes, []), v)))::INT codes_only_a, len(list_filter(coalesce(y.codes, []), lambda v: not list_contains(coalesce(x.codes, []), v)))::INT codes_only_b from x full join y on x.variable = y.variable")
def s7_layout_reconciliation(t):
    """Two layouts derived from two extracts (a brand's sizes as its span, its types as its codes): where they disagree."""
    sold = t.lineitem.join(t.part, c("l_partkey") == c("p_partkey"))

    def layout(flag: str):
        of = sold.where(c("l_returnflag") == flag).groupBy(c("p_brand").alias("variable"))
        # a brand has as many codes as there are types
        return of.agg(F.min("p_size").alias("start"), F.max("p_size").alias("end"), F.lit("string").alias("type"), F.collect_set("p_type").alias("codes"))

    return fixed_width.reconcile(layout("A"), layout("R"))


@query('with l as (select p_brand variable, min(p_partkey) a, min(p_partkey) + max(p_size) % 7 b from part group by 1), g as (select *, a - lag(b) over (order by a, b) - 1 gap from l) select variable, a "start", b "end", gap from g where gap <> 0')
def s8_layout_gaps(t):
    """Gaps and overlaps between the fields of a layout derived from data: one field a brand."""
    start = F.min("p_partkey")
    return fixed_width.gaps(t.part.groupBy(c("p_brand").alias("variable")).agg(start.alias("start"), (start + F.max("p_size") % 7).alias("end")))
