"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Used only where a session on one machine names no spark.checkpoint.dir, as in tests.
LOCAL_DIR = "file:///tmp/checkpoints/fieldloom"
#: A side of a join is broadcast up to this many rows; beyond, both sides shuffle.
BROADCAST_ROWS = 200_000
#: A key with over 1/HOT of all rows is hot, so there are fewer than HOT of them; so is one with over HOT_ROWS, of which
#: there are few until the table has BROADCAST_ROWS times as many rows.
HOT, HOT_ROWS = 1000, 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        folder = LOCAL_DIR
    if not folder:
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return folder.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Writes df to a new folder in the shared one and reads it back: lineage ends here, and a lost executor costs nothing."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased; other letters stay as they are."""
    return F.translate(c, UPPER, LOWER)


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows (counted here; df should be a written table), else df as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def attach(rows: DataFrame, table: DataFrame, key: str, spread: Column, total: int, how: str = "left") -> DataFrame:
    """Looks up each row's key in table, which has one row a key and group_rows, the number of rows with that key.

    One key may hold a third of the rows. Keys with over 1/HOT of the total are fewer than HOT, so these are broadcast, and
    so are those with over HOT_ROWS while these are at most total / HOT_ROWS <= BROADCAST_ROWS keys; the rest join by
    shuffle, with the hot rows dealt out by spread. how: left or inner.
    """
    values = F.struct(*[F.col(c) for c in table.columns if c != key])
    is_hot = F.col("group_rows") > max(min(total / HOT, HOT_ROWS), total / BROADCAST_ROWS)
    hot = table.where(is_hot).select(F.col(key).alias("_hot_key"), values.alias("_hot"))
    cold = table.where(~is_hot).select(F.col(key).alias("_cold_key"), F.lit(0).cast("long").alias("_cold_salt"), values.alias("_cold"))
    out = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    out = out.withColumn("_salt", F.when(F.col("_hot_key").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(spread), F.lit(1 << 16)) + 1).cast("long"))
    out = out.join(cold, (F.col(key) == F.col("_cold_key")) & (F.col("_salt") == F.col("_cold_salt")), "left")
    out = out.withColumn("_found", F.coalesce("_hot", "_cold"))
    if how == "inner":
        out = out.where(F.col("_found").isNotNull())
    return out.select(*rows.columns, "_found.*")


def per_row(df: DataFrame, column: str, function: Callable[[list], list[list]], fields: dict[str, pa.DataType], ddl: str, binary: bool = True) -> DataFrame:
    """Replaces a text column by what function makes of a batch of its values: one list for each field.

    The values arrive as UTF-8 bytes, or as str with binary=False. Other columns pass by untouched.
    """
    others = [c for c in df.columns if c != column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = part.column(part.schema.get_field_index(column))
                made = function((texts.cast(pa.binary()) if binary else texts).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index(c)) for c in others] + [pa.array(v, t) for v, t in zip(made, fields.values(), strict=True)],
                    names=[*others, *fields],
                )

    return df.mapInArrow(run, T.StructType([f for f in df.schema.fields if f.name != column] + T.StructType.fromDDL(ddl).fields))


def named(docs: DataFrame) -> DataFrame:
    """docs as rows (row, id, text_hash): row holds all columns of docs, so that no name of theirs can clash."""
    return docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("text_hash"))


def named_join(docs: DataFrame, side: DataFrame, how: str = "left") -> DataFrame:
    """named(docs) with the columns of side for the same id and text_hash."""
    rows = named(docs)
    side = side.withColumnsRenamed({"id": "side_id", "text_hash": "side_hash"})
    return rows.join(side, rows["id"].eqNullSafe(side["side_id"]) & (rows["text_hash"] == side["side_hash"]), how)


def without(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """docs without the documents that marks (id, text_hash, stays) rejects; columns stay as they are.

    A document is named by its doc_id and the XXH64 of its text. Those that marks does not name are kept; of those with
    stays, which are repeated rows, one is kept. marks must be a written table.
    """
    found = named_join(docs, small_enough(marks.select("id", "text_hash", "stays")))
    out = found.where("stays is null")
    if marks.where("stays").limit(1).count():
        out = out.unionByName(found.where("stays").dropDuplicates(["id", "text_hash"]))
    return out.select("row.*")
