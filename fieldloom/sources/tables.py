"""Table sources and sinks: Parquet and CSV, write-once folders, manifests, provenance."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A Parquet table, pruned to columns."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def new_folder(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share; on one machine, without such a setting, in a local one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        folder = "/tmp/checkpoints/fieldloom"
    if not folder:
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written to a new folder in the shared one and read back: what follows it starts there, also after a lost executor."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in floating columns becomes NULL, the one missing value of the library."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(F.isnan(c), F.lit(None)).otherwise(F.col(c)) for c in floats})


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True, mode="errorifexists")


def write_once(df: DataFrame, path: str) -> None:
    """Parquet in a new folder; fails if the folder exists."""
    df.write.mode("errorifexists").parquet(path)


def with_notes(df: DataFrame, notes: str) -> DataFrame:
    """df as strings with a last row that holds notes in its first column; row_order sorts it last."""
    rows = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns], F.lit(0).alias("row_order"))
    note = df.sparkSession.createDataFrame([(notes, 1)], f"`{df.columns[0]}` string, row_order int")
    return rows.unionByName(note, allowMissingColumns=True)


def fingerprint(df: DataFrame) -> Column:
    """An order-insensitive aggregate over all columns: equal tables have equal fingerprints."""
    return F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("fingerprint")


def manifest(inputs: dict[str, DataFrame], **config: str) -> DataFrame:
    """One row per input: its row count, content fingerprint, schema and the run's settings."""
    parts = []
    for name, df in inputs.items():
        row = df.agg(F.count(F.lit(1)).alias("n_rows"), fingerprint(df))
        parts.append(row.select(F.lit(name).alias("input"), "n_rows", "fingerprint", F.lit(df.schema.simpleString()).alias("columns"), F.to_json(F.create_map(*[F.lit(x) for kv in sorted(config.items()) for x in kv])).alias("config")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def with_provenance(df: DataFrame) -> DataFrame:
    """Adds the file that a row came from and the time of reading."""
    return df.withColumns({"source_file": F.col("_metadata.file_name"), "read_at": F.current_timestamp()})


def decode(df: DataFrame, column: str, labels: DataFrame, variable: str) -> DataFrame:
    """Adds <column>_label from a label table (variable, code, label)."""
    own = labels.where(F.col("variable") == variable).select(F.col("code").alias("_code"), F.col("label").alias(f"{column}_label"))
    return df.join(own, F.col(column) == F.col("_code"), "left").drop("_code")
