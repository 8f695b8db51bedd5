"""Benchmark decontamination with DataFrame functions only.

A window is `window` consecutive words of a benchmark item, or a shorter item as a whole. Of every occurrence of a window
of L words in a document, one g-gram (g = half of L, rounded up) starts at a multiple of L - g + 1, so a document is a
suspect only if one of its g-grams at these strides is in the broadcast hash set of the benchmark's g-grams. Suspects are
read again and all their windows are compared word for word. The hash set is broadcast at every size of the benchmark: in
rounds of ROUND_GRAMS hashes (about 40 MB), each of which scans the documents' hashes once more, and so are the windows.

Defined cases: null and empty texts have no words. Documents are named by doc_id and text, so repeated rows get the same
result each; a null doc_id is a value like any other. An item with a null item_id counts as a window but is not listed.
Other columns may have any names (cut_contaminated replaces one named kept_words); empty tables give none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, named_join, small_enough, without, written

#: Fixed: what stands between words, once A-Z is lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Hashes, and windows of some 100 bytes, that one broadcast holds.
ROUND_GRAMS, ROUND_WINDOWS = 1_000_000, 200_000


def tokens(text: str | Column) -> Column:
    """The words of a text; none for null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), BETWEEN, -1), "")


def benchmark_windows(benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Distinct item_id, size (words), text of the benchmark's windows."""
    items = benchmark.select(F.col("item_id"), tokens("text").alias("w")).where(F.size("w") > 0).withColumn("size", F.least(F.size("w"), F.lit(window)))
    return items.select("item_id", "size", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1), lambda i: F.array_join(F.slice("w", i, F.col("size")), " "))).alias("window")).distinct()


def broadcast_join(rows: DataFrame, table: DataFrame, on: list[str], most: int, how: str) -> DataFrame:
    """rows joined with a written table in as many rounds as its broadcasts of about so many rows take."""
    rounds = max(1, -(-table.count() // most))
    part = lambda i: table if rounds == 1 else table.where(F.pmod(F.xxhash64(*on), F.lit(rounds)) == i)
    out = rows.join(F.broadcast(part(0)), on, how)
    for i in range(1, rounds):
        out = out.unionByName(rows.join(F.broadcast(part(i)), on, how))
    return out


def half(size: int) -> int:
    return (size + 1) // 2


def strided_grams(words: Column, size: int) -> Column:
    """Hashes of the g-grams of which each run of so many words holds one whole."""
    g = half(size)
    made = F.transform(F.sequence(F.lit(1), F.size(words) - g + 1, F.lit(size - g + 1)), lambda i: F.xxhash64(F.slice(words, i, g)))
    return F.when(F.size(words) >= size, made).otherwise(F.array().cast("array<bigint>"))


def all_windows(words: Column, size: int) -> Column:
    made = F.transform(F.sequence(F.lit(1), F.size(words) - size + 1), lambda i: F.struct(i.alias("at"), F.lit(size).alias("size"), F.array_join(F.slice(words, i, size), " ").alias("window")))
    return F.when(F.size(words) >= size, made).otherwise(F.array().cast("array<struct<at:int,size:int,window:string>>"))


def covered(spans: Column) -> Column:
    """How many words the spans (at, size) cover together."""
    end = lambda s: s["at"] + s["size"] - 1
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda a, s: F.struct(F.greatest(a["end"], end(s)).alias("end"), (a["n"] + F.greatest(F.lit(0), end(s) - F.greatest(a["end"], s["at"] - 1))).alias("n"))
    return F.aggregate(F.array_sort(spans), zero, step)["n"]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> tuple[DataFrame, DataFrame]:
    """(counted, hits): id, text_hash and n_words of every row of docs; id, text_hash, spans and items of each contaminated document."""
    name = [F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("text_hash")]
    windows = written(benchmark_windows(benchmark, window), "benchmark-windows")
    sizes = [r[0] for r in windows.select("size").distinct().orderBy("size").collect()]  # at most `window` of them
    grams = F.array_distinct(F.concat(*[strided_grams(F.col("w"), n) for n in sizes])) if sizes else F.array().cast("array<bigint>")
    counted = written(docs.select(*name, tokens("text").alias("w")).select("id", "text_hash", F.size("w").cast("long").alias("n_words"), grams.alias("grams")), "document-grams")
    g = F.ceil(F.col("size") / 2).cast("int")
    split = windows.select("size", F.split("window", " ").alias("w"))
    wanted = written(split.select(F.explode(F.transform(F.sequence(F.lit(1), F.col("size") - g + 1), lambda i: F.xxhash64(F.slice("w", i, g)))).alias("gram")).distinct(), "benchmark-grams")
    suspects = broadcast_join(counted.select("id", "text_hash", F.explode("grams").alias("gram")), wanted, ["gram"], ROUND_GRAMS, "left_semi").select(F.col("id").alias("s_id"), F.col("text_hash").alias("s_hash")).distinct()
    side = small_enough(written(suspects, "suspects"))
    texts = docs.select(*name, F.col("text").alias("text"))
    texts = texts.join(side, texts["id"].eqNullSafe(side["s_id"]) & (texts["text_hash"] == side["s_hash"]), "left_semi").select("id", "text_hash", tokens("text").alias("w"))
    every = F.concat(*[all_windows(F.col("w"), n) for n in sizes]) if sizes else F.array().cast("array<struct<at:int,size:int,window:string>>")
    found = texts.select("id", "text_hash", F.explode(every).alias("x")).select("id", "text_hash", "x.at", "x.size", "x.window")
    found = broadcast_join(found, windows, ["size", "window"], ROUND_WINDOWS, "inner")
    hits = found.groupBy("id", "text_hash").agg(F.collect_set(F.struct("at", "size")).alias("spans"), F.collect_set(F.col("item_id").cast("string")).alias("items"))
    return counted.select("id", "text_hash", "n_words"), hits


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    counted, hits = contamination(docs, benchmark, window)
    hits = written(hits.select(F.col("id").alias("h_id"), F.col("text_hash").alias("h_hash"), covered(F.col("spans")).alias("n_hit"), F.array_sort("items").alias("items")), "hits")
    side = small_enough(hits)
    items = F.coalesce("items", F.array().cast("array<string>"))
    out = counted.join(side, counted["id"].eqNullSafe(side["h_id"]) & (counted["text_hash"] == side["h_hash"]), "left")
    return out.select(
        F.col("id").alias("doc_id"), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """docs without the documents that hold a benchmark window; columns stay as they are."""
    _, hits = contamination(docs, benchmark, window)
    return without(docs, written(hits.select("id", "text_hash", F.lit(False).alias("stays")), "contaminated"))


def cut_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """docs with kept_words: the words of each document without those in a benchmark window."""
    _, hits = contamination(docs, benchmark, window)
    found = named_join(docs, small_enough(written(hits.select("id", "text_hash", F.array_sort("spans").alias("spans")), "spans")))
    # the gaps between merged spans, as (start, words) slices
    zero = F.struct(F.lit(1).alias("next"), F.array().cast("array<struct<at:int,n:int>>").alias("gaps"))
    step = lambda a, s: F.struct(F.greatest(a["next"], s["at"] + s["size"]).alias("next"), F.when(s["at"] > a["next"], F.concat(a["gaps"], F.array(F.struct(a["next"].alias("at"), (s["at"] - a["next"]).alias("n"))))).otherwise(a["gaps"]).alias("gaps"))
    out = found.select("row", tokens(F.col("row.text")).alias("w"), F.aggregate(F.col("spans"), zero, step).alias("cut"))
    rest = F.slice("w", F.col("cut.next"), F.greatest(F.size("w") - F.col("cut.next") + 1, F.lit(0)))
    left = F.concat(F.flatten(F.transform(F.col("cut.gaps"), lambda x: F.slice("w", x["at"], x["n"]))), rest)
    columns = [F.col("row").getField(c).alias(c) for c in docs.columns if c != "kept_words"]
    return out.select(*columns, F.coalesce(left, F.col("w")).alias("kept_words"))
