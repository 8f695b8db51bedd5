"""Registration of queries with their SQL, and access to the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of one folder, read on access: t.orders, t.lineitem, ..."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return read_table(self.spark, f"{self.sf_dir}/{name}.parquet")

    @property
    def households(self) -> DataFrame:
        """Orders with their cluster, stratum and group: customer, nation and region."""
        return self.orders.join(self.customer, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(self.nation), F.col("c_nationkey") == F.col("n_nationkey"))

    @property
    def units(self) -> DataFrame:
        """Line items with their household, cluster, stratum and group."""
        return self.lineitem.join(self.households, F.col("l_orderkey") == F.col("o_orderkey"))


#: The same joins in SQL.
HOUSEHOLDS = "orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey"
UNITS = "lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey"


def query(sql: str | None = None):
    """Registers a function of Tables as a query under its name, with the SQL that gives the same rows."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def n_rows() -> Column:
    return F.count(F.lit(1)).alias("n")
