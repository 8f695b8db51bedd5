"""Importance resampling towards a target's distribution of hashed features.

Every feature of a text (a run of words) falls into a bucket. A bucket's gain is the logarithm of its share in the target over
its share in the documents; the gains are an array by bucket, and a document's weight is the sum of the array at its
features. A Gumbel draw by doc_id makes the highest scores a sample without replacement.

Steps: features to buckets, written once; counts by bucket, of which at most `buckets` numbers reach the driver; scores,
written; the cutoff by bisection of the numeric range of scores, then of the doc_ids tied at it, where a job counts exactly
in all parts that six halvings make; the rows above are partitioned by range and ranked by the offsets of their partitions.
Rows that are not drawn are never sorted or joined.

Defined cases: null and empty texts have no words. Rows that repeat a doc_id draw the same number; they rank one after the
other, by features and then by their place in the table. A null doc_id is drawn as the empty string and comes after the others
of a tie. Without documents of enough words, or with fewer than a whole one to draw, nothing is drawn; an empty target has
no features, so all gains come from the documents alone. Other columns may have any names, extra ones are ignored; empty
tables give none.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .decontaminate import tokens

#: How often one job halves the range of a cutoff.
BITS = 6
MOST = 2**63 - 1


def hashed(words: str | Column, runs: tuple[int, int], buckets: int) -> Column:
    """The buckets of all runs of so many consecutive words, joined by a space: CRC-32 modulo buckets."""
    words = F.col(words) if isinstance(words, str) else words

    def joined(n: int) -> Column:
        if n == 1:
            return words
        made = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))
        return F.when(F.size(words) >= n, made).otherwise(F.array().cast("array<string>"))

    made = [F.transform(joined(n), lambda f: (F.crc32(f.cast("binary")) % buckets).cast("int")) for n in range(runs[0], runs[1] + 1)]
    return made[0] if len(made) == 1 else F.concat(*made)


def bucket_counts(features: DataFrame, buckets: int) -> list[int]:
    """How often each bucket occurs; features has arrays of buckets."""
    counts = [0] * buckets
    for bucket, n in features.select(F.explode("buckets").alias("bucket")).groupBy("bucket").count().collect():
        counts[bucket] = n
    return counts


def gains(target: list[int], source: list[int]) -> list[int]:
    """Thousandths of the logarithm of smoothed shares, rounded down, by bucket."""
    k, t_all, s_all = len(source), float(sum(target)), float(sum(source))
    return [math.floor(1000 * math.log((t + 1) * (s_all + k) / ((s + 1) * (t_all + k)))) for t, s in zip(map(float, target), map(float, source), strict=True)]


def cutoff(rows: DataFrame, key: Column, k: int) -> tuple[int, int]:
    """The largest value that at least k rows reach, and how many rows are above it. rows: a written table of at least k > 0 rows."""
    low, high = rows.agg(F.min(key), F.max(key)).first()
    above = 0
    while low < high:
        shift = max(0, (high - low).bit_length() - BITS)
        counts = dict(rows.where(key.between(low, high)).groupBy(F.shiftright(key, shift)).count().collect())  # at most 2 ** BITS + 1
        for part in sorted(counts, reverse=True):
            if above + counts[part] >= k:
                break
            above += counts[part]
        low, high = max(low, part << shift), min(high, ((part + 1) << shift) - 1)
    return low, above


def scored(docs: DataFrame, target: DataFrame, runs: tuple[int, int] = (1, 1), buckets: int = 10_000, seed: int = 2024, keep: bool = False) -> DataFrame:
    """A written table of doc_id, n_words, n_features, weight, score, place, and with keep also row (all columns of docs)."""
    kept = [F.struct("*").alias("row")] if keep else []
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *kept, tokens("text").alias("words"))
    features = written(texts.select(*[c for c in texts.columns if c != "words"], F.size("words").alias("n_words"), hashed("words", runs, buckets).alias("buckets")), "importance-features")
    wanted = bucket_counts(target.select(tokens("text").alias("words")).select(hashed("words", runs, buckets).alias("buckets")), buckets)
    array = F.split(F.lit(",".join(map(str, gains(wanted, bucket_counts(features, buckets))))), ",").cast("array<bigint>")
    weight = F.aggregate("buckets", F.lit(0).cast("long"), lambda a, b: a + F.get(array, b))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    out = features.withColumn("n_features", F.size("buckets").cast("long")).withColumn("weight", weight).withColumn("score", F.col("weight") + noise)
    return written(out.withColumn("place", F.monotonically_increasing_id()).drop("buckets"), "importance-scores")


def ranked(rows: DataFrame) -> DataFrame:
    """rows with rank, 1 up, by falling score, then doc_id, features and place."""
    key = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("place")]
    ordered = written(rows.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("at", F.monotonically_increasing_id()), "importance-ranks")
    # the upper bits of at are a partition, the lower ones the place in it
    starts, upto = [], 0
    for part, n in sorted(ordered.groupBy(F.shiftright("at", 33)).count().collect()):  # one row a partition
        starts.append((part, upto))
        upto += n
    table = rows.sparkSession.createDataFrame(starts or [(0, 0)], "part long, before long")
    out = ordered.join(F.broadcast(table), F.shiftright("at", 33) == F.col("part"))
    return out.withColumn("rank", F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1).drop("at", "part", "before")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, **options) -> DataFrame:
    """Per document: doc_id, n_features, weight, score, rank (null unless drawn), and row with keep.

    Of the N documents with enough words, floor(percent * N / 100) are drawn by falling score.
    """
    rows = scored(docs, target, **options)
    enough = rows.where(F.col("n_words") >= min_words)
    k = percent * enough.count() // 100
    columns = [c for c in rows.columns if c not in ("n_words", "place")]
    if k < 1:
        return rows.select(*columns, F.lit(None).cast("long").alias("rank"))
    score, above = cutoff(enough, F.col("score"), k)
    # of the rows tied at the cutoff, the smallest ids: the largest of their complements
    tied = F.bitwise_not(F.coalesce("doc_id", F.lit(MOST)))
    last, _ = cutoff(enough.where(F.col("score") == score), tied, k - above)
    taken = (F.col("n_words") >= min_words) & ((F.col("score") > score) | ((F.col("score") == score) & (tied >= last)))
    # repeated rows may tie beyond the k-th
    drawn = ranked(rows.where(taken)).withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")))
    return rows.where(~taken).select(*columns, F.lit(None).cast("long").alias("rank")).unionByName(drawn.select(*columns, "rank"))


def draw(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn documents: docs' columns and importance_rank (which replaces a column of that name)."""
    out = resample(docs, target, keep=True, **options).where("rank is not null")
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c != "importance_rank"], F.col("rank").alias("importance_rank"))
