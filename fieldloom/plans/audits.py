"""Import, pooling and run audits, and final tables: S2, S11, Q14, G4, G26, G28, G29, G30, G38, G42, G47, R6."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from fieldloom.functions import calendar as C
from fieldloom.operators import contracts as K
from fieldloom.operators import joins as J
from fieldloom.operators import recode as R
from fieldloom.operators import runs
from fieldloom.sources import tables as T
from fieldloom.sources.tables import new_folder, stored

from .base import HOUSEHOLDS, UNITS, n_rows, query
from .recode import LAT, LON

c = F.col


@query("select 2 n_columns, count(*) n_in_file, count(o_orderkey) n_read, count(*) = count(o_orderkey) complete, max(o_orderkey) last_key from orders")
def s2_selective_read(t):
    """Two columns of a file, and whether as many rows arrive as its metadata names."""
    rows = T.read_table(t.spark, f"{t.sf_dir}/orders.parquet", ["o_orderkey", "o_orderstatus"])
    counted = rows.agg(F.count("o_orderkey").alias("n_read"), F.max("o_orderkey").alias("last_key"))
    n = t.orders.count()  # from the file's footer
    return counted.select(F.lit(len(rows.columns)).alias("n_columns"), F.lit(n).cast("long").alias("n_in_file"), "n_read", (c("n_read") == n).alias("complete"), "last_key")


@query("select o_orderstatus, count(*) n, round(sum(o_totalprice), 2) total, true second_refused from orders group by 1")
def s11_write_once(t):
    """A run's folder is written once: a second run with the same name is refused and changes nothing."""
    folder, rows = new_folder(t.spark, "run"), t.orders.select("o_orderstatus", "o_totalprice")
    T.write_once(rows, folder)
    try:
        T.write_once(rows.limit(0), folder)
        refused = False
    except AnalysisException:
        refused = True
    return t.spark.read.parquet(folder).groupBy("o_orderstatus").agg(n_rows(), F.round(F.sum("o_totalprice"), 2).alias("total")).withColumn("second_refused", F.lit(refused))


CONTRACT = [("l_orderkey", "bigint"), ("l_partkey", "int"), ("l_quantity", "double"), ("l_comment", "string"), ("l_shipdate", "timestamp_ntz")]


@query(
    f"""with e(name, kind) as (values {", ".join(str(x) for x in CONTRACT)}),
    a as (select column_name as name, case column_type when 'BIGINT' then 'bigint' when 'INTEGER' then 'int' when 'DOUBLE' then 'double' when 'VARCHAR' then 'string' else 'timestamp_ntz' end kind from (describe lineitem))
    select coalesce(e.name, a.name) as "column", case when a.name is null then 'missing' when e.name is null then 'surplus' else 'type ' || a.kind || ', not ' || e.kind end problem from e full join a on e.name = a.name where e.kind is distinct from a.kind"""
)
def q14_schema_contract(t):
    """What a table's columns and types are against those that a step requires."""
    return t.spark.createDataFrame(K.schema_report(t.lineitem, CONTRACT), "column string, problem string")


@query(
    """with p as (select l_returnflag part, count(*) n, round(sum(l_quantity), 2) quantity from lineitem group by 1),
    k as (select part, count(distinct key) n_keys, max(n) most from (select l_returnflag part, concat_ws('-', l_returnflag, l_orderkey, l_linenumber) as key, count(*) over (partition by l_returnflag, l_orderkey, l_linenumber) n from lineitem) group by 1)
    select part, n n_part, n n_pooled, quantity quantity_part, quantity quantity_pooled, n_keys, most > 1 keys_repeat, true reconciles from p join k using (part)"""
)
def g4_pool_groups(t):
    """Tables of three groups pooled under one schema with keys that name the group, and each reconciled with its part."""
    columns = ["l_orderkey", "l_linenumber", "l_quantity"]
    parts = {flag: t.lineitem.where(c("l_returnflag") == flag).select(*columns) for flag in ("A", "N", "R")}
    pooled = J.union_same([df.withColumn("part", F.lit(flag)) for flag, df in parts.items()])
    pooled = pooled.withColumn("key", F.concat_ws("-", "part", "l_orderkey", "l_linenumber"))
    keys = pooled.groupBy("part", "key").agg(n_rows(), F.sum("l_quantity").alias("q"))
    after = keys.groupBy("part").agg(F.sum("n").alias("n_pooled"), F.round(F.sum("q"), 2).alias("quantity_pooled"), F.count(F.lit(1)).alias("n_keys"), (F.max("n") > 1).alias("keys_repeat"))
    before = t.lineitem.groupBy(c("l_returnflag").alias("part")).agg(F.count(F.lit(1)).alias("n_part"), F.round(F.sum("l_quantity"), 2).alias("quantity_part"))
    same = (c("n_part") == c("n_pooled")) & (F.abs(c("quantity_part") - c("quantity_pooled")) < 0.005)
    return before.join(after, "part", "full_outer").select("part", "n_part", "n_pooled", "quantity_part", "quantity_pooled", "n_keys", "keys_repeat", F.coalesce(same, F.lit(False)).alias("reconciles"))


BREAKDOWNS = {
    "status": "o_orderstatus", "priority": "o_orderpriority", "segment": "c_mktsegment", "nation": "n_name", "flag": "l_returnflag",
    "size": "case when l_quantity <= 10 then '0-10' when l_quantity <= 30 then '10-30' else '30+' end", "tax": "case when l_tax <= 0.02 then 'low' when l_tax <= 0.05 then 'middle' else 'high' end",
}
MEASURES = {"price": "case when l_quantity >= 3 then l_extendedprice end", "discount": "case when l_discount > 0 then l_discount end", "filled": "case when o_orderstatus <> 'P' then 1 end"}


@query(
    f"""with u as (select n_regionkey::VARCHAR r, {", ".join(f"{v} b_{k}" for k, v in BREAKDOWNS.items())}, {", ".join(f"{v} m_{k}" for k, v in MEASURES.items())} from {UNITS}),
    s as (select 'ALL' scope, * from u union all select r, * from u),
    l as ({" union all ".join(f"select scope, '{k}' breakdown, b_{k} as level, {', '.join(f'm_{m}' for m in MEASURES)} from s" for k in BREAKDOWNS)})
    select scope, breakdown, level, count(*) n, {", ".join(f"round(100.0 * count(m_{m}) / count(*), 6) {m}" for m in MEASURES)} from l group by 1, 2, 3"""
)
def g26_full_availability(t):
    """Availability of three measures by seven breakdowns, pooled and in every region, in one scan."""
    rows = t.units.select(c("n_regionkey").cast("string").alias("r"), *[F.expr(v).alias(f"b_{k}") for k, v in BREAKDOWNS.items()], *[F.expr(v).alias(f"m_{k}") for k, v in MEASURES.items()])
    levels = F.array(*[F.struct(F.lit(k).alias("breakdown"), c(f"b_{k}").alias("level")) for k in BREAKDOWNS])
    out = rows.withColumn("scope", F.explode(F.array(F.lit("ALL"), c("r")))).select("scope", F.inline(levels), *[f"m_{m}" for m in MEASURES])
    return out.groupBy("scope", "breakdown", "level").agg(n_rows(), *[F.round(100 * F.count(f"m_{m}") / F.count(F.lit(1)), 6).alias(m) for m in MEASURES])


IMPORTED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CHECKS = {"early": "l_shipdate < o_orderdate", "late": "l_shipdate > o_orderdate + interval 120 days", "discount_range": "l_discount < 0 or l_discount > 0.1", "not_positive": "l_quantity <= 0 or l_extendedprice <= 0", "no_cluster": "c_custkey is null", "no_stratum": "n_nationkey is null"}


@query(
    f"""with u as (select * from lineitem left join orders on l_orderkey = o_orderkey left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey)
    {" union all ".join(f"select 'availability' section, '{x}' item, count({x}) n, round(min({x}), 4) low, round(max({x}), 4) high from lineitem" for x in IMPORTED)}
    union all {" union all ".join(f"select 'check', '{k}', count(*) filter (where {v}), null, null from u" for k, v in CHECKS.items())}
    union all select 'keys', 'repeated', count(*), null, null from (select 1 from lineitem group by l_orderkey, l_linenumber having count(*) > 1)"""
)
def g28_import_validation(t):
    """Availability and range of each variable, dates, ranges, design identifiers and keys of an extract."""
    blank = lambda df: df.withColumns({"low": F.lit(None).cast("double"), "high": F.lit(None).cast("double")}).select("section", "item", "n", "low", "high")
    each = F.array(*[F.struct(F.lit(x).alias("item"), c(f"n_{x}").alias("n"), c(f"a_{x}").alias("low"), c(f"b_{x}").alias("high")) for x in IMPORTED])
    held = t.lineitem.agg(*[f(x).alias(f"{s}_{x}") for x in IMPORTED for s, f in (("n", F.count), ("a", lambda x: F.round(F.min(x), 4)), ("b", lambda x: F.round(F.max(x), 4)))])
    available = held.select(F.lit("availability").alias("section"), F.inline(each))
    rows = t.lineitem.join(t.orders, c("l_orderkey") == c("o_orderkey"), "left").join(t.customer, c("o_custkey") == c("c_custkey"), "left").join(F.broadcast(t.nation), c("c_nationkey") == c("n_nationkey"), "left")
    checks = K.rules(rows, {k: F.expr(v) for k, v in CHECKS.items()}).select(F.lit("check").alias("section"), c("contract").alias("item"), c("violations").alias("n"))
    keys = K.unique_key(t.lineitem, ["l_orderkey", "l_linenumber"]).agg(n_rows()).select(F.lit("keys").alias("section"), F.lit("repeated").alias("item"), "n")
    return available.unionByName(blank(checks)).unionByName(blank(keys))


@query(
    """with l as (select l_orderkey, sum(l_extendedprice) total from lineitem group by 1)
    select o_orderpriority, count(*) n, count(*) filter (where l_orderkey is null) n_not_listed, count(*) filter (where o_orderstatus = 'P') n_not_measured, count(*) filter (where l_orderkey is null and o_orderstatus = 'P') n_both,
        count(*) filter (where total > o_totalprice) n_above, round(corr(total, o_totalprice), 6) r from orders left join l on l_orderkey = o_orderkey group by 1"""
)
def g29_supplementary_checks(t):
    """Rows that are not listed against rows that are listed but not measured, and how two totals relate."""
    totals = t.lineitem.groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("total"))
    rows = t.orders.join(totals, c("o_orderkey") == c("l_orderkey"), "left")
    absent, unmeasured = c("l_orderkey").isNull(), c("o_orderstatus") == "P"
    return rows.groupBy("o_orderpriority").agg(n_rows(), F.count_if(absent).alias("n_not_listed"), F.count_if(unmeasured).alias("n_not_measured"), F.count_if(absent & unmeasured).alias("n_both"), F.count_if(c("total") > c("o_totalprice")).alias("n_above"), F.round(F.corr("total", "o_totalprice"), 6).alias("r"))


#: A unit is eligible if it ships 30 to 90 days after the order; the other rules shift one of the two dates.
SHIFTS = {"order_plus_30": "days - 30", "ship_minus_30": "days - 30 * (days > 60)::INT", "ship_plus_30": "days + 30"}
FLAGS = {"cheap": "l_extendedprice < 20000", "few": "l_quantity < 10", "late": "days > 90"}
#: The area that a source covers: least and largest latitude and longitude.
BOX = (-40, 60, -100, 100)
UNIT_LAT, UNIT_LON = (x.replace("c_custkey", "o_custkey") for x in (LAT, LON))


@query(
    f"""with u as (select *, date_diff('day', o_orderdate::DATE, l_shipdate::DATE) as days from {UNITS}), e as (select *, days between 30 and 90 base, {", ".join(f"({v}) between 30 and 90 {k}" for k, v in SHIFTS.items())}, {", ".join(f"({v})::INT f_{k}" for k, v in FLAGS.items())}, ({UNIT_LAT})::DOUBLE lat, ({UNIT_LON})::DOUBLE lon from u),
    k as (select year(o_orderdate) - 8 y, month(o_orderdate) m, month(l_shipdate) s, count(*) n from u group by 1, 2, 3), d as (select *, unnest(range(1, 31))::INT as d from k),
    p as (select y, m, s, n, bool_or(fits) possible, bool_or(fits and d = 1) opens from (select *, month(date '0001-01-01' + (2796 + 365 * (y - 1) + y // 4 + 30 * (m - 1) + d - 2)::INT) = (s + 7) % 12 + 1 fits from d) group by 1, 2, 3, 4)
    {" union all ".join(f"select 'shift' section, '{k}' item, count(*) filter (where {k} and not base) a, count(*) filter (where base and not {k}) b from e" for k in SHIFTS)}
    union all select 'flags', 'any_and_all', count(*) filter (where f_cheap + f_few + f_late > 0), count(*) filter (where f_cheap + f_few + f_late = 3) from e
    union all select 'flags', 'one_and_two', count(*) filter (where f_cheap + f_few + f_late = 1), count(*) filter (where f_cheap + f_few + f_late = 2) from e
    union all select 'bounds', 'near_and_beyond', count(*) filter (where abs(l_discount - 0.1) <= 0.0100001), count(*) filter (where l_discount > 0.1) from e
    union all select 'cascade', 'eligible', count(*) filter (where base), count(*) filter (where not base) from e
    union all select 'cascade', 'not_cheap', count(*) filter (where base and f_cheap = 0), count(*) filter (where base and f_cheap = 1) from e
    union all select 'coordinates', 'missing_and_sentinel', count(*) filter (where lat is null or lon is null), count(*) filter (where lat = 0 and lon = 0) from e
    union all select 'coordinates', 'covered_and_not', count(*) filter (where lat <> 0 and lon <> 0 and lat between {BOX[0]} and {BOX[1]} and lon between {BOX[2]} and {BOX[3]}), count(*) filter (where not coalesce(lat <> 0 and lon <> 0 and lat between {BOX[0]} and {BOX[1]} and lon between {BOX[2]} and {BOX[3]}, false)) from e
    union all select 'months', 'possible_and_not', coalesce(sum(n) filter (where possible), 0)::BIGINT, coalesce(sum(n) filter (where not possible), 0)::BIGINT from p
    union all select 'calendar', 'opens_in_month_and_not', coalesce(sum(n) filter (where opens), 0)::BIGINT, coalesce(sum(n) filter (where not opens), 0)::BIGINT from p"""
)
def g30_resolution_checks(t):
    """Eligibility under shifted dates, how flags coincide, values near a bound, the readiness cascade and the coverage of coordinates, in
    one scan; then whether the order's month of the other calendar can, and its first day does, fall in the month eight
    after the shipping one, by distinct months."""
    rows = t.units.withColumn("days", F.date_diff(c("l_shipdate").cast("date"), c("o_orderdate").cast("date")))
    shifted = {"order_plus_30": c("days") - 30, "ship_minus_30": c("days") - 30 * (c("days") > 60).cast("int"), "ship_plus_30": c("days") + 30}
    base, flags = c("days").between(30, 90), sum((F.expr(v).cast("int") for v in FLAGS.values()), F.lit(0))
    cheap = F.expr(FLAGS["cheap"])
    pairs = {("shift", k): (v.between(30, 90) & ~base, base & ~v.between(30, 90)) for k, v in shifted.items()}
    pairs |= {("flags", "any_and_all"): (flags > 0, flags == 3), ("flags", "one_and_two"): (flags == 1, flags == 2), ("bounds", "near_and_beyond"): (F.abs(c("l_discount") - 0.1) <= 0.0100001, c("l_discount") > 0.1)}
    pairs |= {("cascade", "eligible"): (base, ~base), ("cascade", "not_cheap"): (base & ~cheap, base & cheap)}
    place = R.valid_coordinates(F.expr(UNIT_LAT).cast("double"), F.expr(UNIT_LON).cast("double"), BOX)
    pairs |= {("coordinates", "missing_and_sentinel"): (place == "missing", place == "sentinel"), ("coordinates", "covered_and_not"): (place == "ok", place != "ok")}
    months = rows.groupBy((F.year("o_orderdate") - 8).alias("y"), F.month("o_orderdate").alias("m"), F.month("l_shipdate").alias("s")).agg(n_rows())
    fits = lambda d: F.month(C.other_to_gregorian(c("y"), c("m"), d)) == (c("s") + 7) % 12 + 1
    whole = lambda x: F.coalesce(F.sum(F.when(x, c("n"))), F.lit(0))
    judged = [("months", "possible_and_not", F.exists(F.sequence(F.lit(1), F.lit(30)), fits)), ("calendar", "opens_in_month_and_not", fits(F.lit(1)))]
    held = months.agg(*[f.alias(f"{s}{i}") for i, (_, _, x) in enumerate(judged) for s, f in (("a", whole(x)), ("b", whole(~x)))])
    by_month = held.select(F.inline(F.array(*[F.struct(F.lit(s).alias("section"), F.lit(k).alias("item"), c(f"a{i}").alias("a"), c(f"b{i}").alias("b")) for i, (s, k, _) in enumerate(judged)])))
    counts = rows.agg(*[F.count_if(x).alias(f"{s}{i}") for i, p in enumerate(pairs.values()) for s, x in zip("ab", p, strict=True)])
    counts = counts.select(F.inline(F.array(*[F.struct(F.lit(s).alias("section"), F.lit(k).alias("item"), c(f"a{i}").alias("a"), c(f"b{i}").alias("b")) for i, (s, k) in enumerate(pairs)])))
    return counts.unionByName(by_month)


@query(
    f"""with u as (select n_regionkey, o_custkey g, month(l_shipdate) m, l_discount x from {UNITS}), d as (select n_regionkey, x, x - avg(x) over (partition by g) wx, x - avg(x) over (partition by g, m) wmx from u)
    select n_regionkey, count(*) n, round(stddev_pop(x), 8) sd, round(sqrt(avg(wx * wx)), 8) within_sd, round(avg(wx * wx) / var_pop(x), 8) within_share, round(sqrt(avg(wmx * wmx)), 8) within_month_sd from d group by 1"""
)
def g38_design_diagnostics(t):
    """An exposure's variation in each region: in all, within clusters, and within the months of a cluster; from sums by cell."""
    x = c("l_discount")
    cells = t.units.groupBy("n_regionkey", "o_custkey", F.month("l_shipdate").alias("m")).agg(n_rows(), F.sum(x).alias("s"), F.sum(x * x).alias("q"))
    clusters = cells.groupBy("n_regionkey", "o_custkey").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(c("q") - c("s") * c("s") / c("n")).alias("r"))
    out = clusters.groupBy("n_regionkey").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(c("q") - c("s") * c("s") / c("n")).alias("w"), F.sum("r").alias("r"))
    total = c("q") - c("s") * c("s") / c("n")
    return out.select("n_regionkey", "n", F.round(F.sqrt(total / c("n")), 8).alias("sd"), F.round(F.sqrt(c("w") / c("n")), 8).alias("within_sd"), F.round(c("w") / total, 8).alias("within_share"), F.round(F.sqrt(c("r") / c("n")), 8).alias("within_month_sd"))


@query(
    """with a as (select o_custkey k, avg(o_totalprice) mean, count(*) n from orders group by 1),
    b as (select k, case when k % 10 = 1 then 'nan'::DOUBLE when k % 10 = 2 then 'inf'::DOUBLE when k % 10 = 3 then null when k % 10 = 4 then mean + 1 else mean end mean, case when k % 7 = 0 then n + 1 else n end n from a where k % 11 <> 0 union all select -k, mean, n from a where k % 13 = 0),
    j as (select a.k ak, b.k bk, a.mean am, b.mean bm, a.n an, b.n bn from a full join b on a.k = b.k)
    select 'mean' as "column", case when bk is null then 'only_a' when ak is null then 'only_b' when bm is null then 'finite to missing' when isnan(bm) then 'finite to nan' when isinf(bm) then 'finite to +inf' when am = bm then 'same' else 'differs' end outcome, count(*) n from j group by 2
    union all select 'n', case when bk is null then 'only_a' when ak is null then 'only_b' when an = bn then 'same' else 'differs' end, count(*) from j group by 2"""
)
def g42_compare_runs(t):
    """Two runs of a statistic by cluster, the second with lost, new and changed rows: the outcome of each column."""
    # a run is written: worked out twice, a mean may end on another last digit
    first = stored(t.orders.groupBy(c("o_custkey").alias("k")).agg(F.avg("o_totalprice").alias("mean"), n_rows()), "run")
    damaged = F.when(c("k") % 10 == 1, float("nan")).when(c("k") % 10 == 2, float("inf")).when(c("k") % 10 == 3, F.lit(None)).when(c("k") % 10 == 4, c("mean") + 1).otherwise(c("mean"))
    second = first.where("k % 11 <> 0").select("k", damaged.alias("mean"), F.when(c("k") % 7 == 0, c("n") + 1).otherwise(c("n")).alias("n"))
    second = second.unionByName(first.where("k % 13 = 0").select((-c("k")).alias("k"), "mean", "n"))
    return runs.compare_runs(first, second, "k", ["mean", "n"], 0.0)


DAMAGED = {
    "k % 7 = 0": ("status", "'refused'"), "k % 10 = 1": ("mean", "cast('nan' as double)"), "k % 10 = 2": ("mean", "mean + 0.5"), "k % 10 = 3": ("mean", "null"), "k % 19 = 0": ("segment", "null"), "k % 23 = 0": ("n", "n + 2"),
}


def _damaged(column: str) -> str:
    return "case " + " ".join(f"when {k} then {v}" for k, (x, v) in DAMAGED.items() if x == column) + f" else {column} end {column}"


@query(
    f"""with a as (select o_custkey k, any_value(c_mktsegment) segment, case when count(*) > 8 then 'estimated' else 'few_rows' end status, avg(o_totalprice) mean, count(*) n, 1.5::DOUBLE dropped from orders join customer on o_custkey = c_custkey group by 1),
    b0 as (select k, {", ".join(_damaged(x) for x in ("segment", "status", "mean", "n"))}, 'x' AS added from a where k % 11 <> 0), b as (select * from b0 union all select * from b0 where k % 29 = 0 union all select -k, segment, status, mean, n, added from b0 where k % 31 = 1),
    bn as (select *, count(*) over (partition by k) times from b), j as (select a.k ak, bn.k bk, coalesce(times, 1) > 1 twice, a.segment s1, bn.segment s2, a.status t1, bn.status t2, a.mean m1, bn.mean m2, a.n n1, bn.n n2 from a full join (select distinct on (k) * from bn) bn on a.k = bn.k),
    v as (select * from j where ak is not null and bk is not null and not twice),
    text as (select item, case when u is not distinct from v then 'same' when v is null then 'text to missing' else 'differs' end outcome from (select unnest(['segment', 'status']) item, unnest([s1, t1]) u, unnest([s2, t2]) v from v)),
    num as (select item, case when v is null then 'finite to missing' when isnan(v) then 'finite to nan' when abs(u - v) <= 1e-9 then 'same' else 'differs' end outcome, case when not isnan(v) then abs(u - v) end gap from (select unnest(['mean', 'n']) item, unnest([m1, n1]) u, unnest([m2, n2]) v from v))
    select 'columns' AS section, 'dropped' item, 'only_a' outcome, count(distinct 1) n, null::DOUBLE largest from a union all select 'columns', 'added', 'only_b', count(distinct 1), null from b
    union all select 'keys', null, case when bk is null then 'only_a' else 'only_b' end, count(*), null from j where ak is null or bk is null group by 3 union all select 'keys', null, 'repeated_in_b', count(*), null from j where twice group by 3
    union all select 'values', item, outcome, count(*), null from text group by 2, 3 union all select 'values', item, outcome, count(*), round(max(gap), 9) from num group by 2, 3"""
)
def g42_run_report(t):
    """Two runs of a table of fits by cluster, the second with other columns, keys, statuses, labels and numbers: the whole report."""
    rows = t.orders.join(t.customer, c("o_custkey") == c("c_custkey")).groupBy(c("o_custkey").alias("k"))
    first = rows.agg(F.min("c_mktsegment").alias("segment"), F.when(F.count(F.lit(1)) > 8, "estimated").otherwise("few_rows").alias("status"), F.avg("o_totalprice").alias("mean"), n_rows(), F.lit(1.5).alias("dropped"))
    second = first.where("k % 11 <> 0").selectExpr("k", *[_damaged(x) for x in ("segment", "status", "mean", "n")], "'x' added")
    second = second.unionByName(second.where("k % 29 = 0")).unionByName(second.where("k % 31 = 1").withColumn("k", -c("k")))
    return runs.report(first, second, "k", ["segment", "status", "mean"]).counts.withColumn("largest", F.round("largest", 9))


@query(
    f"""with h as (select n_regionkey::VARCHAR r, * from {HOUSEHOLDS}), s as (select 'ALL' scope, * from h union all select r, * from h)
    select 'characteristics' part, scope, 'balance' item, printf('%.2f (%.2f)', avg(c_acctbal), stddev_samp(c_acctbal)) cell from s group by 2
    union all select 'characteristics', scope, 'price', printf('%.1f (%.1f)', avg(o_totalprice), stddev_samp(o_totalprice)) from s group by 2
    union all select 'outcomes', scope, o_orderstatus, printf('%d', count(*)) from s group by 2, 3
    union all select 'sizes', scope, 'clusters', printf('%d', count(distinct o_custkey)) from s group by 2"""
)
def g47_final_tables(t):
    """Characteristics, outcomes and sizes in one table of cells, pooled and by region."""
    rows = t.households.withColumn("scope", F.explode(F.array(F.lit("ALL"), c("n_regionkey").cast("string"))))
    pair = lambda x, d: F.format_string(f"%.{d}f (%.{d}f)", F.avg(x), F.stddev_samp(x))
    sums = rows.groupBy("scope").agg(pair("c_acctbal", 2).alias("balance"), pair("o_totalprice", 1).alias("price"), F.format_string("%d", F.countDistinct("o_custkey")).alias("clusters"))
    parts = {"balance": "characteristics", "price": "characteristics", "clusters": "sizes"}
    cells = sums.select("scope", F.inline(F.array(*[F.struct(F.lit(p).alias("part"), F.lit(x).alias("item"), c(x).alias("cell")) for x, p in parts.items()])))
    outcomes = rows.groupBy("scope", c("o_orderstatus").alias("item")).agg(F.format_string("%d", F.count(F.lit(1))).alias("cell")).withColumn("part", F.lit("outcomes"))
    return cells.unionByName(outcomes).select("part", "scope", "item", "cell")


@query(
    f"""with a as (select n_name item, round(avg(o_totalprice), 6) mean, count(*) n from {HOUSEHOLDS} where o_orderstatus = 'F' group by 1), b as (select n_name item, round(avg(o_totalprice), 6) mean, count(*) n from {HOUSEHOLDS} where o_orderstatus = 'O' group by 1)
    select 'A1' panel, coalesce(a.item, b.item) item, a.mean mean_first, b.mean mean_second, a.n n_first, b.n n_second, round(a.mean - b.mean, 6) difference from a full join b on a.item = b.item
    union all select 'A2', o_orderpriority, round(avg(o_totalprice), 6), null, count(*), null, null from orders group by 2"""
)
def r6_appendix(t):
    """Two result tables merged side by side, and a third stacked below them."""
    stats = lambda df, s: df.agg(F.round(F.avg("o_totalprice"), 6).alias(f"mean_{s}"), F.count(F.lit(1)).alias(f"n_{s}"))
    first, second = (stats(t.households.where(c("o_orderstatus") == x).groupBy(c("n_name").alias("item")), s) for x, s in (("F", "first"), ("O", "second")))
    merged = first.join(second, "item", "full_outer").withColumn("difference", F.round(c("mean_first") - c("mean_second"), 6))
    return J.union_panels({"A1": merged, "A2": stats(t.orders.groupBy(c("o_orderpriority").alias("item")), "first")})
