"""Queries of joins, sets, and order: J1 to J17, U1 to U4, O1 to O5."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.operators import joins as J

from .base import HOUSEHOLDS, n_rows, query

STATUS = "case o_orderstatus when 'F' then 1.0 when 'O' then 0.0 end"


@query("select (select count(*) from (select o_orderkey from orders group by 1 having count(*) > 1)) dup_left, (select count(*) from (select l_orderkey from lineitem group by 1 having count(*) > 1)) dup_right, (select count(*) from orders where o_orderkey in (select l_orderkey from lineitem)) matched, (select count(*) from orders where o_orderkey not in (select l_orderkey from lineitem)) unmatched")
def j1_one_to_one_report(t):
    return J.join_report(t.orders.select("o_orderkey"), t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])


@query("select o_orderpriority, count(*) n, count(*) filter (where c_custkey is null) n_unmatched from orders left join (select * from customer where c_acctbal >= 0) on o_custkey = c_custkey group by 1")
def j2_many_to_one(t):
    """Orders attached to the customers that are listed; those without one are counted."""
    listed = t.customer.where("c_acctbal >= 0").select("c_custkey")
    return t.orders.join(listed, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("o_orderpriority").agg(n_rows(), F.count_if(F.col("c_custkey").isNull()).alias("n_unmatched"))


@query("with a as (select l_orderkey k, sum(l_extendedprice) v from lineitem group by 1), b as (select o_orderkey k, o_totalprice v from orders) select k, round(abs(a.v - b.v), 4) abs_difference from a join b using (k)")
def j3_reconciliation(t):
    a = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_extendedprice").alias("v_a"))
    return a.join(t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v_b")), "k").select("k", F.round(F.abs(F.col("v_a") - F.col("v_b")), 4).alias("abs_difference"))


@query("with a as (select o_custkey k, count(*) n from orders where o_orderstatus = 'F' group by 1), b as (select o_custkey k, count(*) n from orders where o_orderstatus = 'O' group by 1) select coalesce(a.k, b.k) k, case when a.k is null then 'only_right' when b.k is null then 'only_left' else 'both' end side, a.n n_a, b.n n_b from a full join b on a.k = b.k")
def j4_outer_sides(t):
    count = lambda s: t.orders.where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("k")).agg(n_rows())
    return J.outer_sides(count("F"), count("O"), ["k"], ["n"])


@query("with a as (select o_orderpriority, year(o_orderdate)::INT y, round(avg(o_totalprice), 7) m from orders where o_orderstatus = 'F' group by 1, 2), b as (select o_orderpriority, year(o_orderdate)::INT y, round(avg(o_totalprice), 7) m from orders where o_orderstatus = 'P' group by 1, 2) select coalesce(a.o_orderpriority, b.o_orderpriority) o_orderpriority, coalesce(a.y, b.y) y, case when a.y is null then 'only_right' when b.y is null then 'only_left' else 'both' end side, a.m m_a, b.m m_b from a full join b on a.o_orderpriority = b.o_orderpriority and a.y = b.y")
def j5_outer_on_terms(t):
    mean = lambda s: t.orders.where(F.col("o_orderstatus") == s).groupBy("o_orderpriority", F.year("o_orderdate").alias("y")).agg(F.round(F.avg("o_totalprice"), 7).alias("m"))
    return J.outer_sides(mean("F"), mean("P"), ["o_orderpriority", "y"], ["m"])


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders)")
def j6_unmatched_keys(t):
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("select o_custkey from orders where o_orderstatus = 'F' intersect select o_custkey from orders where o_orderstatus = 'O' intersect select o_custkey from orders where o_orderstatus = 'P'")
def j7_common_keys(t):
    keys = lambda s: t.orders.where(F.col("o_orderstatus") == s).select("o_custkey")
    return keys("F").intersect(keys("O")).intersect(keys("P"))


@query("select o_orderkey, o_custkey from orders where o_custkey in (select o_custkey from orders group by 1 having count(distinct o_orderstatus) > 1)")
def j8_varying_clusters(t):
    varying = t.orders.groupBy("o_custkey").agg(F.countDistinct("o_orderstatus").alias("k")).where("k > 1")
    return t.orders.join(varying, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


PANEL = f"select c_nationkey nation, year(o_orderdate) y, avg({STATUS}) v from {HOUSEHOLDS} group by 1, 2"


@query(f"""
    with panel as ({PANEL}),
    h as (select o_orderkey, c_nationkey nation, year(o_orderdate) * 12 + month(o_orderdate) - 1 s from {HOUSEHOLDS}),
    e as (select o_orderkey, nation, s, unnest(range((s // 12)::BIGINT, ((s + 11) // 12)::BIGINT + 1)) y from h),
    w as (select o_orderkey, nation, y, (least(s + 11, y * 12 + 11) - greatest(s, y * 12) + 1) / 12 w from e)
    select o_orderkey, case when count(*) = count(v) then round(sum(w * v), 8) end exposure, count(v) n_years from w left join panel using (nation, y) group by 1""")
def j9_interval_lookup(t):
    rows = t.households.select("o_orderkey", F.col("c_nationkey").alias("nation"), (F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1).cast("long").alias("s"), F.year("o_orderdate").cast("long").alias("year"), F.expr(STATUS).cast("double").alias("v"))
    panel = rows.groupBy("nation", "year").agg(F.avg("v").alias("v"))
    spread = J.spread_years(rows, F.col("s"), F.lit(12), ["o_orderkey", "nation"])
    found = spread.join(panel, ["nation", "year"], "left")
    whole = F.count(F.lit(1)) == F.count("v")
    return found.groupBy("o_orderkey").agg(F.when(whole, F.round(F.sum(F.col("weight") * F.col("v")), 8)).alias("exposure"), F.count("v").alias("n_years"))


@query("with o as (select o_custkey, o_orderkey, case o_orderstatus when 'F' then 1 when 'O' then 0 end v from orders) select o_orderkey, (select round(avg(b.v), 8) from o b where b.o_custkey = a.o_custkey and b.o_orderkey <> a.o_orderkey) others_rate from o a where o_custkey % 20 = 0")
def j10_theta_self_join(t):
    """The stated query set (clusters whose id is divisible by 20) against all rows of their own cluster: checks w1."""
    rows = t.orders.select("o_custkey", "o_orderkey", F.expr(STATUS).cast("double").alias("v"))
    asks = rows.where("o_custkey % 20 = 0").select("o_custkey", F.col("o_orderkey").alias("k"))
    pairs = asks.join(rows, "o_custkey").where("k <> o_orderkey")
    means = pairs.groupBy("k").agg(F.round(F.avg("v"), 8).alias("others_rate"))
    return asks.join(means, "k", "left").select(F.col("k").alias("o_orderkey"), "others_rate")


@query("with g as (select p_partkey % 50 r, p_size c, round(avg(p_retailprice), 6) v from part group by 1, 2) select s_suppkey, v from supplier left join g on g.r = s_suppkey % 50 and g.c = s_nationkey + 1")
def j12_cell_lookup(t):
    """The value of the cell that holds each point; points in cells without a value stay."""
    grid = t.part.groupBy((F.col("p_partkey") % 50).alias("r"), F.col("p_size").alias("c")).agg(F.round(F.avg("p_retailprice"), 6).alias("v"))
    points = t.supplier.select("s_suppkey", (F.col("s_suppkey") % 50).alias("r"), (F.col("s_nationkey") + 1).alias("c"))
    return points.join(grid, ["r", "c"], "left").select("s_suppkey", "v")


@query(f"with g as (select n_regionkey, sum(o_totalprice) total from {HOUSEHOLDS} group by 1) select o_orderkey, round(o_totalprice / total, 12) share from {HOUSEHOLDS} join g using (n_regionkey)")
def j13_group_total(t):
    total = t.households.groupBy("n_regionkey").agg(F.sum("o_totalprice").alias("total"))
    return t.households.join(total, "n_regionkey").select("o_orderkey", F.round(F.col("o_totalprice") / F.col("total"), 12).alias("share"))


@query("with c as (select o_orderkey, unnest(['early', 'middle', 'late']) candidate, unnest([0, 6, 12]) shift, year(o_orderdate) * 12 + month(o_orderdate) m from orders where o_orderkey % 6 = 0 union all select o_orderkey, 'reported', 0, year(o_orderdate) * 12 + month(o_orderdate) from orders where o_orderkey % 6 <> 0) select o_orderkey, candidate, m + shift as month from c")
def j14_candidate_fan_out(t):
    month = (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long")
    pick = lambda name, shift: F.struct(F.lit(name).alias("candidate"), (month + shift).alias("month"))
    candidates = F.when(F.col("o_orderkey") % 6 == 0, F.array(pick("early", 0), pick("middle", 6), pick("late", 12))).otherwise(F.array(pick("reported", 0)))
    return t.orders.select("o_orderkey", F.inline(candidates))


@query("with d as (select distinct l_orderkey, l_returnflag from lineitem), f as (select l_orderkey, min(l_returnflag) flag from d group by 1) select count(*) n, count(*) filter (where flag = 'R' and o_orderstatus = 'O') n_disagree from f join orders on l_orderkey = o_orderkey")
def j15_agreement_audit(t):
    first = t.lineitem.groupBy("l_orderkey").agg(F.min("l_returnflag").alias("flag"))
    both = first.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return both.agg(n_rows(), F.count_if((F.col("flag") == "R") & (F.col("o_orderstatus") == "O")).alias("n_disagree"))


@query("with b as (select o_orderkey, case when o_orderkey % 7 = 0 then 'X' else o_orderstatus end o_orderstatus, o_totalprice from orders where o_orderkey % 11 <> 0) select case when b.o_orderkey is null then 'only_left' else 'both' end side, count(*) n, count(*) filter (where a.o_orderstatus is not distinct from b.o_orderstatus) same_status, count(*) filter (where a.o_totalprice is not distinct from b.o_totalprice) same_price from orders a left join b using (o_orderkey) group by 1")
def j16_version_comparison(t):
    later = t.orders.where("o_orderkey % 11 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus")))
    rows = J.outer_sides(t.orders, later, ["o_orderkey"], ["o_orderstatus", "o_totalprice"])
    same = lambda c: F.count_if(F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b")))
    return rows.groupBy("side").agg(n_rows(), same("o_orderstatus").alias("same_status"), same("o_totalprice").alias("same_price"))


@query("select n_nationkey, count(distinct n_regionkey) n_zones from nation join customer on n_nationkey = c_nationkey group by 1")
def j17_hierarchy(t):
    return t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_nationkey").agg(F.countDistinct("n_regionkey").alias("n_zones"))


@query("select o_orderpriority p, o_totalprice x from orders where o_orderstatus = 'F' union all select c_mktsegment, c_acctbal from customer")
def u1_same_schema_union(t):
    return J.union_same([t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderpriority").alias("p"), F.col("o_totalprice").alias("x")), t.customer.select(F.col("c_mktsegment").alias("p"), F.col("c_acctbal").alias("x"))])


@query("select 'orders' panel, o_orderkey k, o_totalprice price, null::DOUBLE balance from orders union all select 'customers', c_custkey, null, c_acctbal from customer")
def u2_panel_union(t):
    return J.union_panels({"orders": t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price")), "customers": t.customer.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("balance"))})


@query("select p_partkey from part except select l_partkey from lineitem where l_quantity > 45")
def u3_set_difference(t):
    return t.part.select("p_partkey").subtract(t.lineitem.where("l_quantity > 45").select("l_partkey"))


@query("select side, c from (values ('both', 'c_custkey'), ('only_left', 'c_acctbal'), ('only_left', 'c_mktsegment'), ('only_left', 'c_name'), ('only_left', 'c_nationkey'), ('only_right', 'n')) v(side, c)")
def u4_column_sets(t):
    counts = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(n_rows())
    sets = J.column_sets(t.customer, counts)
    return t.spark.createDataFrame([(side, c) for side, names in sets.items() for c in names], "side string, c string")


@query("select o_orderkey, o_custkey, o_totalprice from orders order by o_custkey, o_totalprice desc, o_orderkey")
def o1_multi_key_sort(t):
    return t.orders.select("o_orderkey", "o_custkey", "o_totalprice").orderBy("o_custkey", F.desc("o_totalprice"), "o_orderkey")


@query("select o_custkey, o_orderkey, rank::INT rank from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) rank from orders) where rank <= 3")
def o2_top_per_group(t):
    return J.top_by(t.orders, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", "rank")


@query("select n_regionkey, min(n_name) reference from nation join customer on n_nationkey = c_nationkey group by 1")
def o3_reference_level(t):
    return t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey").agg(F.min("n_name").alias("reference"))


@query("select o_orderkey from orders order by (o_orderkey * 7919) % 10007, o_orderkey limit 100")
def o4_seeded_sample(t):
    """A sampling operator: 100 rows, the same on every run."""
    return J.sample_rows(t.orders.select("o_orderkey"), 100, F.col("o_orderkey") * 7919 % 10007, "o_orderkey")


@query("select distinct l_orderkey, l_linenumber from lineitem")
def o5_de_duplicate(t):
    return t.lineitem.select("l_orderkey", "l_linenumber").dropDuplicates()


@query("with o as (select o_orderkey, o_custkey, case o_orderstatus when 'F' then 1 when 'O' then 0 end v from orders), s as (select *, sum(v) over w t, count(v) over w n from o window w as (partition by o_custkey)) select o_orderkey, o_custkey, n - (v is not null)::INT others_n, round((t - coalesce(v, 0)) / nullif(n - (v is not null)::INT, 0), 8) others_rate from s")
def w1_leave_one_out(t):
    """For each order, the share of fulfilled ones among the other classifiable orders of its customer."""
    value = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 0)
    return J.leave_one_out(t.orders, "o_custkey", value).select("o_orderkey", "o_custkey", "others_n", F.round("others_rate", 8).alias("others_rate"))
