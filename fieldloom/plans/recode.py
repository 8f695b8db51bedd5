"""Queries of the recode family: P1 to P30."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.operators import recode as R
from fieldloom.operators.quantiles import quantiles

from .base import HOUSEHOLDS, Tables, query

SPECIAL = {9996: "height", 9997: "age", 9998: "flagged", 9999: "not_measured"}
RAW = "case l_partkey % 50 when 0 then null when 1 then 9996 when 2 then 9997 when 3 then 9998 when 4 then 9999 else l_suppkey % 7 * 100 - 300 - l_linenumber end"
STATE = "case when raw is null then 'missing' when raw = 9996 then 'height' when raw = 9997 then 'age' when raw = 9998 then 'flagged' when raw = 9999 then 'not_measured' else 'valid' end"
SEGMENTS = {"AUTOMOBILE": "Improved", "BUILDING": "Improved", "FURNITURE": "Unimproved", "HOUSEHOLD": "Open", "MACHINERY": "Unknown"}
SEGMENT_SQL = "case c_mktsegment when 'AUTOMOBILE' then 'Improved' when 'BUILDING' then 'Improved' when 'FURNITURE' then 'Unimproved' when 'HOUSEHOLD' then 'Open' when 'MACHINERY' then 'Unknown' end"


def raw_units(t: Tables):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.expr(RAW).cast("int").alias("raw"))


@query(f"select state, flag, count(*) n, round(sum(z), 6) sum_z from (select {STATE} state, case when raw >= 9996 then raw::INT end flag, case when raw < 9996 then raw / 100.0 end z from (select {RAW} raw from lineitem)) group by 1, 2")
def p1_special_codes(t):
    state, flag, z = R.special_codes(F.col("raw"), SPECIAL)
    return raw_units(t).select(state.alias("state"), flag.alias("flag"), z.alias("z")).groupBy("state", "flag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("z"), 6).alias("sum_z"))


@query(f"select count(*) n, count(*) filter (where raw is not null and raw <> 9999) n_universe, count(*) filter (where raw < 9996) n_valid from (select {RAW} raw from lineitem)")
def p2_universe_split(t):
    raw = F.col("raw")
    return raw_units(t).agg(F.count(F.lit(1)).alias("n"), F.count_if(raw.isNotNull() & (raw != 9999)).alias("n_universe"), F.count_if(raw < 9996).alias("n_valid"))


@query(f"select low, severe, count(*) n from (select case when z is not null then (z < -2)::INT end low, case when z is not null then (z < -3)::INT end severe from (select case when raw < 9996 then raw / 100.0 end z from (select {RAW} raw from lineitem))) group by 1, 2")
def p3_threshold_indicator(t):
    _, _, z = R.special_codes(F.col("raw"), SPECIAL)
    return raw_units(t).select(z.alias("z")).select(R.below(F.col("z"), -2).alias("low"), R.below(F.col("z"), -3).alias("severe")).groupBy("low", "severe").agg(F.count(F.lit(1)).alias("n"))


@query(f"select c_mktsegment, {SEGMENT_SQL} category, count(*) n from customer group by 1, 2")
def p4_code_map(t):
    return t.customer.groupBy("c_mktsegment", R.code_map(F.col("c_mktsegment"), SEGMENTS).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query(f"select c_mktsegment, {SEGMENT_SQL} core, case c_mktsegment when 'HOUSEHOLD' then 'Improved' else {SEGMENT_SQL} end variant, count(*) n from customer where c_mktsegment = 'HOUSEHOLD' group by 1, 2, 3")
def p5_map_override(t):
    rows = t.customer.select("c_mktsegment", R.code_map(F.col("c_mktsegment"), SEGMENTS).alias("core"), R.code_map(F.col("c_mktsegment"), SEGMENTS | {"HOUSEHOLD": "Improved"}).alias("variant"))
    return rows.where("core <> variant").groupBy("c_mktsegment", "core", "variant").agg(F.count(F.lit(1)).alias("n"))


@query(f"select level, count(*) n from (select case when cat = 'Improved' then case shared when 0 then 'Basic' when 1 then 'Limited' when 7 then 'StructuralNotApplicable' end else cat end as level from (select {SEGMENT_SQL} cat, case c_custkey % 4 when 0 then 0 when 1 then 1 when 2 then 7 end shared from customer)) group by 1")
def p6_service_level(t):
    shared = F.when(F.col("c_custkey") % 4 == 0, 0).when(F.col("c_custkey") % 4 == 1, 1).when(F.col("c_custkey") % 4 == 2, 7)
    return t.customer.groupBy(R.service_level(R.code_map(F.col("c_mktsegment"), SEGMENTS), shared).alias("level")).agg(F.count(F.lit(1)).alias("n"))


@query("select case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'High' when o_orderpriority = '3-MEDIUM' then 'Medium' else 'Low' end priority, count(*) n from orders group by 1")
def p7_category_collapse(t):
    collapse = {"1-URGENT": "High", "2-HIGH": "High", "3-MEDIUM": "Medium"}
    return t.orders.groupBy(F.coalesce(R.code_map(F.col("o_orderpriority"), collapse), F.lit("Low")).alias("priority")).agg(F.count(F.lit(1)).alias("n"))


@query("select o_orderstatus, case o_orderstatus when 'F' then 1 when 'O' then 0 end value, o_orderstatus in ('F', 'O') included, count(*) n from orders group by 1, 2, 3")
def p8_indicator_pair(t):
    value, included = R.indicator(F.col("o_orderstatus"), ["F"], ["O"])
    return t.orders.groupBy("o_orderstatus", value.alias("value"), included.alias("included")).agg(F.count(F.lit(1)).alias("n"))


@query("select o_orderkey, o_totalprice / 1e6 weight from orders")
def p9_constant_scaling(t):
    return t.orders.select("o_orderkey", (F.col("o_totalprice") / 1e6).alias("weight"))


@query(f"select concat(n_regionkey, '_', lpad(c_custkey::VARCHAR, 8, '0')) group_cluster, count(*) n from {HOUSEHOLDS} group by 1")
def p10_group_keys(t):
    return t.households.groupBy(F.concat_ws("_", F.col("n_regionkey").cast("string"), F.lpad(F.col("c_custkey").cast("string"), 8, "0")).alias("group_cluster")).agg(F.count(F.lit(1)).alias("n"))


@query(f"select count(*) n, count(*) filter (where z is not null and l_quantity is not null and l_quantity > 0 and l_discount is not null) n_complete from (select case when raw < 9996 then raw / 100.0 end z, l_quantity, l_discount from (select {RAW} raw, l_quantity, l_discount from lineitem))")
def p11_complete_case(t):
    _, _, z = R.special_codes(F.expr(RAW).cast("int"), SPECIAL)
    rows = t.lineitem.select(z.alias("z"), "l_quantity", "l_discount")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(R.complete(["z", "l_quantity", "l_discount"], "l_quantity")).alias("n_complete"))


@query("select case when o_totalprice is null then 'missing' when o_orderstatus = 'P' then 'pending' when o_totalprice < 1000 then 'small' when o_orderdate < timestamp '1997-01-01' then 'early' else 'eligible' end status, count(*) n from orders group by 1")
def p12_ordered_status(t):
    c = F.col
    status = R.first_match([(c("o_totalprice").isNull(), "missing"), (c("o_orderstatus") == "P", "pending"), (c("o_totalprice") < 1000, "small"), (c("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz"), "early")], "eligible")
    return t.orders.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("select coalesce(case when l_linenumber % 3 > 0 then l_quantity end, l_extendedprice / 1000) age, case when l_linenumber % 3 > 0 then 'reported' else 'derived' end basis, l_orderkey, l_partkey, l_suppkey, l_linenumber from lineitem")
def p13_coalesce_with_source(t):
    reported = F.when(F.col("l_linenumber") % 3 > 0, F.col("l_quantity"))
    return t.lineitem.select(F.coalesce(reported, F.col("l_extendedprice") / 1000).alias("age"), F.when(reported.isNotNull(), "reported").otherwise("derived").alias("basis"), "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


@query(f"select o_orderkey from {HOUSEHOLDS} where n_regionkey = 1")
def p14_scope_filter(t):
    return t.households.where("n_regionkey = 1").select("o_orderkey")


@query(f"select o_orderkey, case when c_nationkey % 2 = 0 then o_totalprice else c_acctbal end exposure from {HOUSEHOLDS}")
def p15_method_switch(t):
    return t.households.select("o_orderkey", F.when(F.col("c_nationkey") % 2 == 0, F.col("o_totalprice")).otherwise(F.col("c_acctbal")).alias("exposure"))


@query("with s as (select o_custkey, count(*) n_orders, count(*) filter (where o_orderstatus <> 'P') n_known from orders group by 1) select o_orderkey, n_orders, n_known from orders join s using (o_custkey) where n_orders >= 10 and n_known >= 5")
def p16_support_thresholds(t):
    support = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"), F.count_if(F.col("o_orderstatus") != "P").alias("n_known"))
    return t.orders.join(support.where("n_orders >= 10 and n_known >= 5"), "o_custkey").select("o_orderkey", "n_orders", "n_known")


LAT, LON = "case when c_custkey % 11 = 0 then 0 when c_custkey % 13 = 0 then null else c_custkey % 170 - 80.5 end", "case when c_custkey % 22 = 0 then 0 else c_custkey % 400 - 195.5 end"


@query(f"select case when lat is null or lon is null then 'missing' when lat = 0 and lon = 0 then 'sentinel' when lat = 0 or lon = 0 then 'one_zero' when not (lat between -90 and 90 and lon between -180 and 180) then 'out_of_range' when not (lat between 3 and 15 and lon between 33 and 48) then 'outside_box' else 'ok' end status, count(*) n from (select ({LAT})::DOUBLE lat, ({LON})::DOUBLE lon from customer) group by 1")
def p17_coordinate_validity(t):
    rows = t.customer.select(F.expr(LAT).cast("double").alias("lat"), F.expr(LON).cast("double").alias("lon"))
    return rows.groupBy(R.valid_coordinates(F.col("lat"), F.col("lon"), (3, 15, 33, 48)).alias("status")).agg(F.count(F.lit(1)).alias("n"))


LEVELS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("select o_orderkey, " + ", ".join(f"(o_orderpriority = '{x}')::INT::DOUBLE o_orderpriority_{i}" for i, x in enumerate(LEVELS) if i) + " from orders")
def p18_dummies(t):
    coded = R.dummies(t.orders, "o_orderpriority", LEVELS, "1-URGENT")
    return coded.select("o_orderkey", *[f"o_orderpriority_{i}" for i in range(1, 5)])


@query(f"with u as (select n_regionkey, year(o_orderdate) y from {HOUSEHOLDS}), f as (select n_regionkey, min(y) first_year from u group by 1) select n_regionkey, y::INT y, first_year::INT first_year, count(*) n, sum((y > first_year)::INT)::BIGINT n_dummy from u join f using (n_regionkey) group by 1, 2, 3")
def p19_group_local_dummies(t):
    rows = t.households.select("n_regionkey", F.year("o_orderdate").alias("y"))
    first = rows.groupBy("n_regionkey").agg(F.min("y").alias("first_year"))
    return rows.join(first, "n_regionkey").groupBy("n_regionkey", "y", "first_year").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("y") > F.col("first_year")).cast("int")).alias("n_dummy"))


@query("select l_orderkey, l_partkey, l_linenumber, l_discount * (l_quantity > 25)::INT x_high, l_discount * (l_quantity <= 25)::INT x_low from lineitem")
def p20_interactions(t):
    band = lambda c: F.col("l_discount") * c.cast("int")
    return t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", band(F.col("l_quantity") > 25).alias("x_high"), band(F.col("l_quantity") <= 25).alias("x_low"))


@query("select case when l_quantity > 0 and l_quantity <= 5 then '0-5' when l_quantity > 5 and l_quantity <= 25 then '5-25' when l_quantity > 25 and l_quantity <= 50 then '25-50' end band, count(*) n from lineitem group by 1")
def p21_right_closed_bins(t):
    return t.lineitem.groupBy(R.right_closed(F.col("l_quantity"), [0, 5, 25, 50], ["0-5", "5-25", "25-50"]).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query(f"with e as (select n_regionkey, quantile_cont(o_totalprice, [0.25, 0.5, 0.75]) q from {HOUSEHOLDS} group by 1) select n_regionkey, case when o_totalprice <= q[1] then 1 when o_totalprice <= q[2] then 2 when o_totalprice <= q[3] then 3 else 4 end as quarter, count(*) n from {HOUSEHOLDS} join e using (n_regionkey) group by 1, 2")
def p22_quantile_bins(t):
    edges = quantiles(t.households, "o_totalprice", [0.25, 0.5, 0.75], "n_regionkey").drop("n")
    x, q = F.col("o_totalprice"), F.col("q")
    return t.households.join(edges, "n_regionkey").groupBy("n_regionkey", F.when(x <= q[0], 1).when(x <= q[1], 2).when(x <= q[2], 3).otherwise(4).alias("quarter")).agg(F.count(F.lit(1)).alias("n"))


@query("select l_quantity::INT::VARCHAR as month, count(*) n from lineitem group by 1")
def p23_month_category(t):
    return t.lineitem.groupBy(F.col("l_quantity").cast("int").cast("string").alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query("select case when v is null then 'null' when isnan(v) then 'nan' when v = 'inf'::DOUBLE then 'plus_inf' when v = '-inf'::DOUBLE then 'minus_inf' else 'finite' end kind, count(*) n from (select case event_id % 9 when 0 then 'nan'::DOUBLE when 1 then 'inf'::DOUBLE when 2 then '-inf'::DOUBLE when 3 then null else value end v from events) group by 1")
def p24_value_class(t):
    k = F.col("event_id") % 9
    v = F.when(k == 0, float("nan")).when(k == 1, float("inf")).when(k == 2, float("-inf")).when(k == 3, F.lit(None)).otherwise(F.col("value"))
    return t.events.groupBy(R.value_class(v).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("select case when abs(d) <= 1e-9 then 'exact' when abs(d) <= 5e-3 then 'rounded' else 'discrepant' end agreement, count(*) n from (select case o_orderkey % 3 when 0 then 0.0 when 1 then 0.001 else 0.2 end d from orders) group by 1")
def p25_tolerance_class(t):
    d = F.when(F.col("o_orderkey") % 3 == 0, 0.0).when(F.col("o_orderkey") % 3 == 1, 0.001).otherwise(0.2)
    return t.orders.groupBy(R.agreement(d).alias("agreement")).agg(F.count(F.lit(1)).alias("n"))


@query("select label, case when lower(label) like '%niu%' or lower(label) like '%not in universe%' then 'niu' when lower(label) like '%missing%' or lower(label) like '%unknown%' then 'missing' when lower(label) like '%flag%' or lower(label) like '%implausible%' then 'flag' else 'value' end kind, count(*) n from (select case o_orderkey % 4 when 0 then 'NIU (not in universe)' when 1 then 'Missing' when 2 then 'Flagged case' else o_orderpriority end label from orders) group by 1, 2")
def p26_label_class(t):
    k = F.col("o_orderkey") % 4
    label = F.when(k == 0, "NIU (not in universe)").when(k == 1, "Missing").when(k == 2, "Flagged case").otherwise(F.col("o_orderpriority"))
    return t.orders.select(label.alias("label")).groupBy("label", R.label_class(F.col("label")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("select length(c_name) = 18 good_length, starts_with(c_name, 'Customer') good_prefix, regexp_full_match(right(c_name, 9), '[0-9]+') digits, count(*) n from customer group by 1, 2, 3")
def p27_identifier_parts(t):
    name = F.col("c_name")
    return t.customer.groupBy((F.length(name) == 18).alias("good_length"), name.startswith("Customer").alias("good_prefix"), F.right(name, F.lit(9)).rlike("^[0-9]+$").alias("digits")).agg(F.count(F.lit(1)).alias("n"))


@query("select case when day(o_orderdate) in (1, 15) then 'rounded_day' when day(o_orderdate) in (28, 29, 30, 31) then 'month_end' else 'exact' end date_precision, count(*) n from orders group by 1")
def p28_date_precision(t):
    day = F.day("o_orderdate")
    return t.orders.groupBy(F.when(day.isin(1, 15), "rounded_day").when(day.isin(28, 29, 30, 31), "month_end").otherwise("exact").alias("date_precision")).agg(F.count(F.lit(1)).alias("n"))


@query(f"with a as (select c_nationkey, corr(o_totalprice, c_acctbal) a, corr(o_totalprice, o_custkey) b from {HOUSEHOLDS} group by 1) select c_nationkey, sign(a) <> sign(b) sign_changed, (abs(a) < 0.05) <> (abs(b) < 0.05) significance_changed from a")
def p29_change_flags(t):
    fits = t.households.groupBy("c_nationkey").agg(F.corr("o_totalprice", "c_acctbal").alias("a"), F.corr("o_totalprice", F.col("o_custkey").cast("double")).alias("b"))
    return fits.select("c_nationkey", R.sign_change(F.col("a"), F.col("b")).alias("sign_changed"), R.significance_change(F.abs("a"), F.abs("b")).alias("significance_changed"))


@query("select o_orderstatus, count(*) n, count(*) filter (where case o_orderstatus when 'F' then 'Filled' when 'O' then 'Open' end is not distinct from case when o_orderkey % 10 = 0 then 'Open' when o_orderstatus = 'F' then 'Filled' else 'Open' end) n_same from orders group by 1")
def p30_code_translation(t):
    own = R.code_map(F.col("o_orderstatus"), {"F": "Filled", "O": "Open"})
    other = F.when(F.col("o_orderkey") % 10 == 0, "Open").when(F.col("o_orderstatus") == "F", "Filled").otherwise("Open")
    return t.orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.count_if(own.eqNullSafe(other)).alias("n_same"))
