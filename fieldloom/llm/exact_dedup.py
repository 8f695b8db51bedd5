"""Exact deduplication against a history that is held as a minimal perfect hash.

The distinct digests of the historical rows are cut into shards; each shard gets a minimal perfect hash whose slots hold
the full digest, the winner's locator (doc_id and row number) and the row count. Digests of fresh rows are looked up in
their shard and compared byte for byte: members update their slot's winner, the others are grouped on their own.

Defined cases: a null text equals the empty one. A null doc_id ranks below every other; a group that has only such rows
keeps one of them and has a null keep_id. Of repeated rows (same doc_id and text) one is kept. Very long texts are
digested whole. Other columns may have any names; empty tables give none.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, per_row, without, written

#: Distinct digests in a shard, on average.
SHARD_DIGESTS = 50_000
#: Bits of a level for each key that is still to be placed, and the number of levels.
GAMMA, LEVELS = 2, 24
INDEX = "shard long, sizes array<long>, levels array<binary>, digests binary, has binary, ids binary, rows binary, counts binary"
GROUPS = "digest binary, keep_has long, keep_id long, keep_row long, group_rows long, known boolean"


def digest_rows(docs: DataFrame) -> DataFrame:
    """One row per document: has (0: doc_id is null, else 1), id (0 for null), row (unique), text_hash, digest (SHA-256 of the text with A-Z lower-cased)."""
    id_ = F.col("doc_id").cast("long")
    rows = docs.select(id_.isNotNull().cast("long").alias("has"), F.coalesce(id_, F.lit(0)).alias("id"), F.monotonically_increasing_id().alias("row"), F.xxhash64("text").alias("text_hash"), F.col("text").alias("text"))
    digests = lambda texts: [[hashlib.sha256((t or b"").lower()).digest() for t in texts]]
    return per_row(rows, "text", digests, {"digest": pa.binary()}, "digest binary")


def place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    """Where the 64-bit keys fall on a level with so many bits."""
    x = keys + np.uint64(0x9E3779B97F4A7C15 * (level + 1) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)


def short_keys(digests: np.ndarray) -> np.ndarray:
    """Digests as rows of 32 bytes -> 64-bit keys."""
    return np.ascontiguousarray(digests[:, 8:16]).view(np.uint64).ravel()


def build_hash(keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Bit arrays by level, and the keys' slots from 0 to len(keys) - 1. Keys that collide on every level get the last slots."""
    levels, slots, left, used = [], np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    for level in range(LEVELS):
        if not len(left):
            break
        size = max(64, GAMMA * len(left))
        at = place(keys[left], level, size)
        bits = np.bincount(at, minlength=size) == 1
        alone = bits[at]
        slots[left[alone]] = used + (np.cumsum(bits) - 1)[at[alone]]
        used += int(bits.sum())
        levels.append(bits)
        left = left[~alone]
    slots[left] = used + np.arange(len(left))
    return levels, slots


def find_slots(keys: np.ndarray, levels: list[np.ndarray]) -> tuple[np.ndarray, int]:
    """The slot of each key (-1: none of the levels has it), and the number of slots on the levels."""
    slots, left, used = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    for level, bits in enumerate(levels):
        at = place(keys[left], level, len(bits))
        hit = bits[at]
        slots[left[hit]] = used + (np.cumsum(bits) - 1)[at[hit]]
        used += int(bits.sum())
        left = left[~hit]
    return slots, used


def _matrix(digests) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 32)


def _build(group: pd.DataFrame) -> pd.DataFrame:
    levels, slots = build_hash(short_keys(_matrix(group["digest"])))
    order = np.argsort(slots)
    longs = lambda c: group[c].to_numpy(np.int64)[order].tobytes()
    return pd.DataFrame({
        "shard": [group["shard"].iloc[0]], "sizes": [[len(b) for b in levels]], "levels": [[np.packbits(b).tobytes() for b in levels]],
        "digests": [_matrix(group["digest"])[order].tobytes()], "has": [longs("has")], "ids": [longs("id")], "rows": [longs("row")], "counts": [longs("n")],
    })


def _resolve(index: pd.DataFrame, fresh: pd.DataFrame) -> pd.DataFrame:
    out = []
    member = np.zeros(len(fresh), bool)
    if len(index):
        held = index.iloc[0]
        digests = np.frombuffer(held["digests"], np.uint8).reshape(-1, 32)
        has, ids, rows, counts = (np.frombuffer(held[c], np.int64).copy() for c in ("has", "ids", "rows", "counts"))
        if len(fresh):
            levels = [np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool) for b, n in zip(held["levels"], held["sizes"], strict=True)]
            wanted = _matrix(fresh["digest"])
            slots, used = find_slots(short_keys(wanted), levels)
            if used < len(digests):  # keys that no level could tell apart
                last = {digests[i].tobytes(): i for i in range(used, len(digests))}
                for i in np.flatnonzero(slots < 0):
                    slots[i] = last.get(wanted[i].tobytes(), -1)
            member = slots >= 0
            member[member] = (digests[slots[member]] == wanted[member]).all(axis=1)
            at, new_has, new_ids, new_rows = slots[member], *(fresh[c].to_numpy(np.int64)[member] for c in ("has", "id", "row"))
            np.add.at(counts, at, fresh["n"].to_numpy(np.int64)[member])
            order = np.lexsort((new_rows, new_ids, new_has, at))
            best = order[np.flatnonzero(np.append(at[order][1:] != at[order][:-1], True))] if len(at) else order
            at, new_has, new_ids, new_rows = at[best], new_has[best], new_ids[best], new_rows[best]
            above = (new_ids > ids[at]) | ((new_ids == ids[at]) & (new_rows > rows[at]))
            wins = (new_has > has[at]) | ((new_has == has[at]) & above)
            has[at[wins]], ids[at[wins]], rows[at[wins]] = new_has[wins], new_ids[wins], new_rows[wins]
        out.append(pd.DataFrame({"digest": [d.tobytes() for d in digests], "keep_has": has, "keep_id": ids, "keep_row": rows, "group_rows": counts, "known": True}))
    if not member.all():
        new = fresh[~member]
        out.append(pd.DataFrame({"digest": new["digest"], "keep_has": new["has"], "keep_id": new["id"], "keep_row": new["row"], "group_rows": new["n"], "known": False}))
    return pd.concat(out) if out else pd.DataFrame({c.split()[0]: [] for c in GROUPS.split(", ")})


def _winners(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy("digest", *by).agg(F.max(F.struct("has", "id", "row")).alias("w"), F.count(F.lit(1)).alias("n")).select("digest", "w.has", "w.id", "w.row", "n")


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """The sharded minimal perfect hash over the distinct digests of rows (has, id, row, digest)."""
    return _winners(history).withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards))).groupBy("shard").applyInPandas(_build, INDEX)


def resolve(index: DataFrame, fresh: DataFrame, shards: int) -> DataFrame:
    """One row per distinct digest of history and fresh rows: digest, keep_has, keep_id, keep_row, group_rows.

    Fresh rows are combined by digest and a salt before they move, so that a hot digest reaches its shard as a few rows.
    """
    combined = _winners(fresh.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(16))), "salt").withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)))
    found = index.groupBy("shard").cogroup(combined.groupBy("shard")).applyInPandas(_resolve, GROUPS)
    found = written(found, "exact-resolved")
    new = found.where(~F.col("known")).groupBy("digest").agg(F.max(F.struct("keep_has", "keep_id", "keep_row")).alias("w"), F.sum("group_rows").alias("group_rows"))
    columns = ["digest", "keep_has", "keep_id", "keep_row", "group_rows"]
    return found.where("known").select(columns).unionByName(new.select("digest", "w.keep_has", "w.keep_id", "w.keep_row", "group_rows"))


def exact_groups(docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """The digest rows and the groups of equal texts of one table, and its row count.

    The older half of the id range, up to the middle, is the history; the rest are fresh rows.
    """
    rows = written(digest_rows(docs), "exact-digests")
    ids = F.when(F.col("has") == 1, F.col("id"))
    low, high, total = rows.agg(F.min(ids), F.max(ids), F.count(F.lit(1))).first()
    middle = 0 if low is None else (low + high) // 2
    shards = max(1, -(-total // SHARD_DIGESTS))
    index = written(build_index(rows.where(F.col("id") <= middle), shards), "exact-index")
    return rows, written(resolve(index, rows.where(F.col("id") > middle), shards), "exact-groups"), total


def exact_dedup(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows, groups, total = exact_groups(docs)
    known = lambda has, c: F.when(F.col(has) == 1, F.col(c))
    return attach(rows, groups, "digest", F.col("row"), total).select(
        known("has", "id").alias("doc_id"), known("keep_has", "keep_id").alias("keep_id"), F.col("group_rows").alias("group_size"),
        (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_repeats(docs: DataFrame) -> DataFrame:
    """docs without the rows whose text another row with a larger doc_id has; columns stay as they are."""
    rows, groups, total = exact_groups(docs)
    judged = attach(rows, groups, "digest", F.col("row"), total).select(F.when(F.col("has") == 1, F.col("id")).alias("id"), "text_hash", (F.col("row") == F.col("keep_row")).alias("stays"))
    marks = judged.groupBy("id", "text_hash").agg(F.max("stays").alias("stays"), F.count(F.lit(1)).alias("n"))
    return without(docs, written(marks.where("n > 1 or not stays"), "exact-marks"))
