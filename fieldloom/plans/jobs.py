"""Whole jobs over several steps: G7 community exposure, G18 common sample, G43 a second route to the exposure."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.operators import contracts as K
from fieldloom.operators import joins as J
from fieldloom.operators.quantiles import quantiles
from fieldloom.sources.tables import stored

from .base import HOUSEHOLDS, UNITS, n_rows, query

c = F.col


def value() -> F.Column:
    return F.when(c("o_orderstatus") == "F", 1).when(c("o_orderstatus") == "O", 0)


def exposed(t) -> DataFrame:
    return J.leave_one_out(t.households, "o_custkey", value())


V = "case o_orderstatus when 'F' then 1 when 'O' then 0 end"
EXPOSED = f"o as (select o_orderkey, o_custkey, n_regionkey, {V} v from {HOUSEHOLDS}), e as (select *, (sum(v) over w - coalesce(v, 0)) / nullif(count(v) over w - (v is not null)::INT, 0) rate from o window w as (partition by o_custkey))"


@query(f"with {EXPOSED} select n_regionkey, count(*) n, count(*) - count(rate) n_missing, round(avg(rate), 7) mean, round(quantile_cont(rate, 0.05), 7) p5, round(median(rate), 7) p50, round(quantile_cont(rate, 0.95), 7) p95 from e join lineitem on l_orderkey = o_orderkey group by 1")
def g7_community_exposure(t):
    """The exposure of every unit through its household: all units keep their row; the distribution by region."""
    units = t.lineitem.select("l_orderkey").join(exposed(t).select("o_orderkey", "n_regionkey", "others_rate"), c("l_orderkey") == c("o_orderkey"))
    units = stored(units.select("n_regionkey", "others_rate"), "unit-exposures")
    plain = units.groupBy("n_regionkey").agg(n_rows(), F.count_if(c("others_rate").isNull()).alias("n_missing"), F.round(F.avg("others_rate"), 7).alias("mean"))
    at = lambda i, name: F.round(c("q")[i], 7).alias(name)
    return plain.join(quantiles(units, "others_rate", [0.05, 0.5, 0.95], "n_regionkey").drop("n"), "n_regionkey", "left").select(*plain.columns, at(0, "p5"), at(1, "p50"), at(2, "p95"))


@query(f"with {EXPOSED}, f as (select *, rate is not null a, rate is not null and v is not null b from e) select unnest(['start', 'community', 'common']) step, unnest([count(*), count(*) filter (where a), count(*) filter (where b)]) n, unnest([count(distinct o_custkey), count(distinct o_custkey) filter (where a), count(distinct o_custkey) filter (where b)]) clusters from f")
def g18_common_sample(t):
    """Rows and clusters left after each exposure is asked for: the sample that all models share."""
    community = c("others_rate").isNotNull()
    steps = F.array(F.lit("start"), F.when(community, "community"), F.when(community & value().isNotNull(), "common"))
    return exposed(t).select("o_custkey", F.explode(steps).alias("step")).where("step is not null").groupBy("step").agg(n_rows(), F.countDistinct("o_custkey").alias("clusters"))


@query(f"with {EXPOSED} select count(*) n, count(*) - count(rate) n_without, 0::BIGINT n_null_differs, 0::BIGINT n_differs from e")
def g43_second_route(t):
    """The exposure by window sums against that by joined sums: where NULL or values differ."""
    own = Window.partitionBy("o_custkey")
    rows = exposed(t).withColumn("v", value().cast("double"))
    others = F.count("v").over(own) - c("v").isNotNull().cast("int")
    rows = rows.withColumn("again", F.try_divide(F.coalesce(F.sum("v").over(own), F.lit(0.0)) - F.coalesce("v", F.lit(0.0)), others))
    null = lambda x: c(x).isNull()
    return rows.agg(n_rows(), F.count_if(null("others_rate")).alias("n_without"), F.count_if(null("others_rate") != null("again")).alias("n_null_differs"), F.count_if(F.abs(c("others_rate") - c("again")) > 1e-9).alias("n_differs"))


@query(
    f"""with h as (select 'c' || c_mktsegment || '_' || n_regionkey region, c_mktsegment country, n_regionkey, n_nationkey, o_custkey, o_totalprice w from {HOUSEHOLDS}), d as (select o_custkey, count(distinct region) k from h group by 1), q as (select n_nationkey, count(distinct n_regionkey) k from h group by 1),
    r as (select country, region, count(*) n, count(distinct o_custkey) clusters, count(distinct n_nationkey) places, sum(w) w from h group by 1, 2),
    x as (select region, count(distinct o_custkey) filter (k > 1) split_clusters from h join d using (o_custkey) group by 1), z as (select region, count(distinct n_nationkey) filter (k > 1) split_places from h join q using (n_nationkey) group by 1)
    select country, region, n, clusters, places, round(100 * n / sum(n) over (partition by country), 6) percent, round(100 * w / sum(w) over (partition by country), 6) weighted_percent, n < 30 small, split_clusters, split_places from r join x using (region) join z using (region)"""
)
def g8_region_identifiers(t):
    """Regions qualified by country (the segment), their size and share of it, and whether clusters and places lie in one region each."""
    rows = t.households.select(c("c_mktsegment").alias("country"), F.concat(F.lit("c"), "c_mktsegment", F.lit("_"), "n_regionkey").alias("region"), "n_regionkey", "n_nationkey", "o_custkey", c("o_totalprice").alias("w"))
    sizes = rows.groupBy("country", "region").agg(n_rows(), F.countDistinct("o_custkey").alias("clusters"), F.countDistinct("n_nationkey").alias("places"), F.sum("w").alias("w"))
    whole = sizes.groupBy("country").agg(F.sum("n").alias("all_n"), F.sum("w").alias("all_w"))

    def split(key: str, value: str, name: str) -> DataFrame:
        """By region, how many of its keys do not determine the value."""
        open_keys = K.depends(rows, key, value).select(c(key).alias("_key"))
        found = rows.select("region", key).distinct().join(open_keys, c(key) == c("_key"), "left")
        return found.groupBy("region").agg(F.count("_key").alias(name))

    out = sizes.join(whole, "country").join(split("o_custkey", "region", "split_clusters"), "region").join(split("n_nationkey", "n_regionkey", "split_places"), "region")
    return out.select("country", "region", "n", "clusters", "places", F.round(100 * c("n") / c("all_n"), 6).alias("percent"), F.round(100 * c("w") / c("all_w"), 6).alias("weighted_percent"), (c("n") < 30).alias("small"), "split_clusters", "split_places")


@query(f"with u as (select l_returnflag, n_regionkey from {UNITS}) select n_regionkey, l_returnflag, count(*) n, round(100 * count(*) / sum(count(*)) over (partition by n_regionkey), 6) percent from u group by 1, 2")
def g8_region_report(t):
    """Categories of units by region with their share of the region."""
    counts = t.units.groupBy("n_regionkey", "l_returnflag").agg(n_rows())
    total = F.sum("n").over(Window.partitionBy("n_regionkey"))
    return counts.withColumn("percent", F.round(100 * c("n") / total, 6))
