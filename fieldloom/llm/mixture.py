"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Sizes are words. Every source gets a target; a source's documents are all taken as often as its target holds its size
whole, and the rest of the target is drawn: its documents, permuted by a hash, are cut into at most BLOCKS blocks, and
blocks are taken in permuted order until the rest is filled (the last one only in part, document by document). The exact
numbers of blocks, those of whole copies counted once a copy, are split among the output shards by a tree: at each node the
left half of the shards draws its part of every source's blocks without replacement. Each copy of a block goes to one shard,
which orders its documents locally.

Sources stay in a table, of any length: their order, targets and quotas are computed there. The tree has two levels of
draws, which together are one multivariate-hypergeometric draw: groups of GROUP sources first, whose block counts are all
that reaches the driver, then the sources of each group in a task. Everything follows from hashes of doc_id (of the text
where that is null) and the seed, so reruns agree.

Defined cases: a null text has size 0 and is taken as often as its source is taken whole. A null source is a source that
sorts last. Rows that repeat doc_id and text within a source are taken alike; a null doc_id is a value like any other. A
source whose documents have no words has target 0. Empty tables give none. Other columns may have any names; draw replaces
those named mix_copy, mix_shard and mix_place.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import attach, written

#: Source weights in order, the mix's share of all sizes, and the most that a source is repeated.
WEIGHTS, SHARE, REPEATS = (3, 1, 2), 1.5, 2.0
BLOCKS, GROUP, SHARDS, SEED = 4096, 4096, 16, 7
#: Blocks of all sources together, since a draw from over a billion copies of blocks is not exact.
MOST_BLOCKS = 300_000_000


def size_of(text: Column) -> Column:
    return F.when(text.isNull(), F.lit(0)).otherwise(F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+", -1), ""))).cast("long")


def targets(sizes: list[int], weights=WEIGHTS, share: float = SHARE, repeats: float = REPEATS) -> list[float]:
    """Words for each source, in order: shares by weight, none above repeats times its size; the excess goes to the others by weight."""
    weigh = [weights[i % len(weights)] for i in range(len(sizes))]
    left, out, free = share * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while free:
        total = sum(weigh[i] for i in free)
        full = {i for i in free if left * weigh[i] / total >= repeats * sizes[i]}
        if not full:
            for i in free:
                out[i] = left * weigh[i] / total
            break
        for i in full:
            out[i] = repeats * sizes[i]
        left -= sum(out[i] for i in full)
        free -= full
    return out


def split_tree(quotas: list[int], shards: int, rng: np.random.Generator, wants: dict[tuple[int, int], int] | None = None) -> np.ndarray:
    """Block counts by shard and source: rows sum to near-equal shares (or to wants), columns to the quotas exactly.

    wants: for each node (first shard, end), how many blocks its left half draws.
    """
    return np.stack([counts for (low, high), counts in sorted(nodes(quotas, shards, rng, wants).items()) if high - low == 1])


def nodes(quotas: list[int], shards: int, rng: np.random.Generator, wants: dict[tuple[int, int], int] | None = None) -> dict[tuple[int, int], np.ndarray]:
    """The tree itself: the block counts by source of each node (first shard, end)."""
    out = {(0, shards): np.array(quotas, np.int64)}

    def part(low: int, high: int) -> None:
        quota, middle = out[low, high], (low + high) // 2
        if high - low == 1:
            return
        want = int(quota.sum()) * (middle - low) // (high - low) if wants is None else wants[low, high]
        drawn, over = np.zeros_like(quota), int(quota.sum())
        for i, n in enumerate(quota.tolist()):  # one source after the other: a multivariate hypergeometric draw
            over -= n
            take = int(rng.hypergeometric(n, over, want)) if want and n + over else 0
            drawn[i], want = take, want - take
        out[low, middle], out[middle, high] = drawn, quota - drawn
        part(low, middle)
        part(middle, high)

    part(0, shards)
    return out


def source_plan(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: float = REPEATS) -> DataFrame:
    """p_source, rank (by code point, null last), source_size, target, whole and rest (words to draw beyond the whole copies)."""
    ordered = rows.groupBy("source").agg(F.sum("size").alias("source_size")).orderBy(F.col("source").asc_nulls_last())
    ordered = written(ordered.withColumn("at", F.monotonically_increasing_id()), "mix-sources")
    # the upper bits of at are a partition, the lower ones the place in it
    before, upto = {}, 0
    for part, n in sorted(ordered.groupBy(F.shiftright("at", 33)).count().collect()):
        before[part], upto = upto, upto + n
    starts = rows.sparkSession.createDataFrame(list(before.items()) or [(0, 0)], "part long, start long")
    ranked = ordered.join(F.broadcast(starts), F.shiftright("at", 33) == F.col("part")).withColumn("rank", F.col("start") + F.col("at").bitwiseAND((1 << 33) - 1))
    plan = written(ranked.withColumn("weigh", F.array(*map(F.lit, weights))[(F.col("rank") % len(weights)).cast("int")]).select("source", "rank", "weigh", "source_size"), "mix-ranks")
    # water-filling: the level rises until no source that shares the rest is above its limit
    left, limit, level = share * (plan.agg(F.sum("source_size")).first()[0] or 0), repeats * F.col("source_size"), 0.0
    full, n_full = F.lit(False), -1
    while True:
        held, weight, n = plan.agg(F.sum(F.when(full, limit)), F.sum(F.when(~full, F.col("weigh"))), F.count_if(full)).first()
        if not weight or n == n_full:
            break
        n_full, level = n, (left - (held or 0.0)) / weight
        full = F.col("weigh") * level >= limit
    target = F.when(full, limit).otherwise(F.col("weigh") * level).cast("double")
    whole = F.when(F.col("source_size") > 0, F.floor(target / F.col("source_size"))).otherwise(0).cast("int")
    plan = plan.select(F.col("source").alias("p_source"), "rank", "source_size", target.alias("target"), whole.alias("whole"))
    return written(plan.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "mix-plan")


def deal(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """e_source and ends: up to which of its blocks each shard goes. quotas: source, rank, n (blocks)."""
    grouped = quotas.withColumn("group", F.floor(F.col("rank") / GROUP).cast("long"))
    totals = sorted(tuple(r) for r in grouped.groupBy("group").agg(F.sum("n")).collect())  # one number for GROUP sources
    at = {g: i for i, (g, _) in enumerate(totals)}
    tree = nodes([n for _, n in totals], shards, np.random.default_rng([seed, 1]))

    def split(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank")
        g = int(group["group"].iloc[0])
        wants = {(low, high): int(tree[low, (low + high) // 2][at[g]]) for low, high in tree if high - low > 1}
        parts = split_tree(group["n"].tolist(), shards, np.random.default_rng(seed + g), wants)
        return pd.DataFrame({"e_source": group["source"], "ends": [x.tolist() for x in np.cumsum(parts, axis=0).T]})

    return grouped.groupBy("group").applyInPandas(split, "e_source string, ends array<long>")


def mixed(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, **aims) -> DataFrame:
    """doc_id, text_hash, source, size, source_size, target, whole (copies of every document), drawn (0 or 1 more), shards (one a copy), place (the order there)."""
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("source").cast("string").alias("source"), size_of(F.col("text")).alias("size"))
    hashed = lambda i: F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", F.lit(i))).otherwise(F.xxhash64("text_hash", F.lit(i)))
    rows = written(rows.withColumns({"block_hash": hashed(seed), "place": hashed(seed + 1)}), "mix-rows")
    plan = source_plan(rows, **aims)
    cuts = max(1, min(BLOCKS, MOST_BLOCKS // max(1, plan.count())))
    # blocks in permuted order (their numbers are hash values), at most BLOCKS a source; a copy of a block is what a shard gets
    sums = written(rows.groupBy("source", F.pmod("block_hash", F.lit(cuts)).alias("block")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("group_rows")), "mix-sums")
    order = Window.partitionBy("source").orderBy("block")
    blocks = sums.join(plan, sums["source"].eqNullSafe(plan["p_source"])).withColumn("upto", F.sum("words").over(order)).withColumn("before", F.col("upto") - F.col("words"))
    begun = F.col("before") < F.col("rest")
    blocks = blocks.withColumns({"entire": F.when(begun, F.col("upto") <= F.col("rest")), "copies": F.col("whole") + begun.cast("int")})
    blocks = written(blocks.drop("p_source", "words", "upto"), "mix-blocks")
    quotas = written(blocks.groupBy("source", "rank").agg(F.sum("copies").alias("n")), "mix-quotas")
    ends = deal(quotas, shards, seed)
    dealt = Window.partitionBy("source").orderBy(F.xxhash64("block", "copy", F.lit(seed + 2)), "block", "copy")
    copies = blocks.where("copies > 0").select("source", "block", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy")).withColumn("nth", F.row_number().over(dealt) - 1)
    copies = copies.join(ends, copies["source"].eqNullSafe(ends["e_source"])).withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("nth"))))
    shard_list = F.transform(F.array_sort(F.collect_list(F.struct("copy", "shard"))), lambda x: x["shard"])
    lists = copies.groupBy(F.col("source").alias("b_source"), F.col("block").alias("b_block")).agg(shard_list.alias("shards"))
    table = blocks.join(lists, blocks["source"].eqNullSafe(lists["b_source"]) & (blocks["block"] == lists["b_block"]), "left").drop("b_source", "b_block", "rank", "copies")
    # a block holds 1 / BLOCKS of a source, so blocks are no hot keys unless one document repeats: attach deals these out
    key = F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull(), "block")
    table = written(table.withColumn("key", key).drop("source", "block"), "mix-table")
    rows = written(attach(rows.withColumn("block", F.pmod("block_hash", F.lit(cuts))).withColumn("key", key), table, "key", F.struct("doc_id", "text_hash"), rows.count()), "mix-drawn")
    # of a source's last block, documents are taken up to that which brings the sum nearest to the target: sums by pieces of
    # the places first, then within each piece
    last = rows.where("not entire").withColumn("piece", F.shiftright("place", 52))
    pieces = last.groupBy("source", "piece").agg(F.sum("size").alias("words"))
    pieces = pieces.select(F.col("source").alias("l_source"), F.col("piece").alias("l_piece"), (F.sum("words").over(Window.partitionBy("source").orderBy("piece")) - F.col("words")).alias("ahead"))
    last = last.join(pieces, last["source"].eqNullSafe(pieces["l_source"]) & (last["piece"] == pieces["l_piece"]))
    upto = F.col("ahead") + F.sum("size").over(Window.partitionBy("source", "piece").orderBy(F.struct("place", "doc_id", "text_hash")))
    last = last.withColumn("drawn", F.when(F.col("before") + upto - F.col("size") / 2 <= F.col("rest"), 1).otherwise(0))
    rest = rows.where("entire is null or entire").withColumn("drawn", F.when(F.col("entire"), 1).otherwise(0))
    columns = [*rest.columns]
    out = rest.unionByName(last.select(columns))
    shards_taken = F.slice(F.coalesce("shards", F.array().cast("array<int>")), F.lit(1), F.col("whole") + F.col("drawn"))
    return out.select("doc_id", "text_hash", "source", "size", "source_size", "target", "whole", "drawn", shards_taken.alias("shards"), "place")


def mix(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (words the mix takes, repeats counted), copies, shards (one a copy), place."""
    out = mixed(docs, **options)
    copies = F.col("whole") + F.col("drawn")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).cast("long").alias("taken"), copies.alias("copies"), "shards", "place")


def draw(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, **aims) -> DataFrame:
    """The mix itself: docs' columns, mix_copy (0 up), mix_shard and mix_place (the order within the shard), one row a copy."""
    plan = mixed(docs, shards, seed, **aims)
    # repeated rows are taken alike, so one row of the plan stands for them
    plan = plan.groupBy(F.col("doc_id").alias("p_id"), F.col("text_hash").alias("p_hash"), F.col("source").alias("p_source")).agg(F.max("shards").alias("p_shards")).where(F.size("p_shards") > 0).hint("shuffle_hash")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("text_hash"), F.col("source").cast("string").alias("from"))
    found = rows.join(plan, rows["id"].eqNullSafe(plan["p_id"]) & (rows["text_hash"] == plan["p_hash"]) & rows["from"].eqNullSafe(plan["p_source"]))
    out = found.select("row", "id", F.posexplode("p_shards").alias("mix_copy", "mix_shard"))
    place = F.xxhash64("id", "mix_copy", F.lit(seed + 1)).alias("mix_place")
    columns = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("mix_copy", "mix_shard", "mix_place")]
    return out.select(*columns, "mix_copy", "mix_shard", place)
