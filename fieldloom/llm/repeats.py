"""Removal of repeated byte strings by merging Burrows-Wheeler transforms.

A `length`-byte string that starts at two places must be found without sorting all suffixes of the corpus.

1. Anchors. Of the GRAM-byte grams of each such string, the one with the least hash is chosen (the rightmost of equal
   ones), so equal strings choose equal grams. The strings that chose one anchor start in a short run of places and
   together span a stretch of bytes. Only anchors whose hash is in the twice-seen Bloom filter (see bloom) can hold a
   repeated string, and only these go on: no string is missed here.
2. Equal stretches are counted together; one that occurs twice repeats all its strings. Different stretches with the same
   anchor hash may share some strings only. One copy of each is dealt to a bucket by the anchor hash, so that equal
   strings always meet, and buckets have a bounded size.
3. The stretches of a bucket are cut into two shards, each with its own Burrows-Wheeler transform over symbols of STEP
   bytes. The two are merged by iterative interleave refinement: the interleave starts with all suffixes of one shard
   before those of the other, and each round deals it out stably by the transforms' symbols, after which it is ordered by
   one more symbol. The round in which two neighbours first fall apart is their common prefix; intervals of neighbours that
   agree for length / STEP rounds are the repeated strings. No suffix is sorted again.
4. An anchor hash with over HOT stretches would not fit a bucket. Its stretches shrink first: strings that a twice-seen
   filter of the strings' digests has seen once are unique, and the runs of the others are shorter stretches, most of
   them equal, which go through steps 2 and 3. If over HOT different ones are left, their strings are counted by their
   digests, an exact way for the rest.

A gram is known by a 64-bit hash, a stretch by a 128-bit digest; symbols are compared byte by byte.

Defined cases: a null text is empty. Strings never cross documents. Texts shorter than `length` lose nothing. Documents
are named by doc_id and text; rows that repeat both are copies of each other, so each loses all its strings of full
length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import attach, written

GRAM, STEP, BUCKET_BYTES, HOT = 64, 50, 1 << 18, 1000
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
BLOCK, PLACES = 1 << 18, (1 << 21) - 1


def powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(pow(base, done, 1 << 64))
        done += more
    return out


class Grams:
    """Hashes of the grams of a text of at most BLOCK + 2 * length bytes."""

    def __init__(self, room: int):
        self.up, self.down = powers(BASE, room), powers(INVERSE, room)

    def hashes(self, text: np.ndarray, gram: int = GRAM) -> np.ndarray:
        sums = np.empty(len(text) + 1, np.uint64)
        sums[0] = 0
        np.cumsum((text.astype(np.uint64) + np.uint64(1)) * self.up[: len(text)], out=sums[1:])
        x = (sums[gram:] - sums[:-gram]) * self.down[: len(text) - gram + 1]
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def sliding_argmin(x: np.ndarray, width: int) -> np.ndarray:
    """For each window of so many values (fewer than 2**21 in all) the place of its least one, the rightmost of equal ones, by the upper 43 bits."""
    low, step = (x & ~np.uint64(PLACES)) | (np.uint64(PLACES) - np.arange(len(x), dtype=np.uint64)), 1
    while step * 2 <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if rest := width - step:
        low = np.minimum(low[:-rest], low[rest:])
    return PLACES - (low & np.uint64(PLACES)).astype(np.int64)


def anchors(text: bytes, length: int, grams: Grams) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By blocks of starts: the anchors' hashes and places, and the first and last starts of the strings that chose them."""
    data = np.frombuffer(text, np.uint8)
    for at in range(0, len(data) - length + 1, BLOCK):
        hashes = grams.hashes(data[at : at + BLOCK + length - 1])
        chosen = sliding_argmin(hashes, length - GRAM + 1)
        edges = np.flatnonzero(chosen[1:] != chosen[:-1])
        first, last = np.concatenate(([0], edges + 1)), np.concatenate((edges, [len(chosen) - 1]))
        yield hashes[chosen[first]], chosen[first] + at, first + at, last + at


def ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the keys, and each one's dense rank."""
    order = np.argsort(keys, kind="stable")
    new = np.empty(len(keys), np.int64)
    sorted_keys = keys[order]
    new[order] = np.cumsum(np.concatenate(([0], sorted_keys[1:] != sorted_keys[:-1])))
    return order, new


class Shard:
    """The sorted suffixes of some stretches and their Burrows-Wheeler transform, over symbols of STEP bytes.

    A stretch of n bytes has n + 1 nodes, one for each place; the last STEP of them are ends, all different and before
    every other. symbols: of a node, 1 up; 0 for an end.
    """

    def __init__(self, starts: np.ndarray, sizes: np.ndarray, symbols: np.ndarray):
        n, first = len(symbols), np.repeat(starts, sizes + 1)
        ends = symbols == 0
        self.ends = int(ends.sum())
        rank = symbols + self.ends
        rank[ends] = np.arange(self.ends)
        order, rank = ranks(rank)
        h = 1
        while h * STEP <= sizes.max(initial=0):  # by twice as many symbols each time
            order, rank = ranks(rank * (n + 1) + rank[np.minimum(np.arange(n) + h * STEP, n - 1)])
            h *= 2
        before = order - STEP
        self.order, self.transform = order, np.where(before >= first[order], symbols[np.maximum(before, 0)], 0)


def merge(a: Shard, b: Shard, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Which slots of the merged order are b's, and which differ from the slot before in their first `rounds` symbols."""
    from_b = np.concatenate((np.zeros(len(a.order), bool), np.ones(len(b.order), bool)))
    apart = np.zeros(len(from_b), bool)
    apart[:1] = True
    ends = a.ends + b.ends
    for _ in range(rounds):
        symbol = np.empty(len(from_b), np.int64)
        symbol[~from_b], symbol[from_b] = a.transform, b.transform
        deal = np.argsort(symbol, kind="stable")
        block = np.cumsum(apart)
        from_b, block, symbol = from_b[deal], block[deal], symbol[deal]
        from_b[:ends] = np.arange(ends) >= a.ends  # every end is the end of a chain that has begun: they keep their order
        apart = np.concatenate(([True], (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1])))
        apart[: ends + 1] = True
    return from_b, apart


def symbols_of(text: np.ndarray, places: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Dense ranks of the STEP-byte symbols at these places: equal ranks for equal bytes. Bytes are compared wherever hashes are equal."""
    grams = np.lib.stride_tricks.sliding_window_view(text, STEP)
    order, rank = ranks(hashes)
    first = np.empty(int(rank.max(initial=-1)) + 1, np.int64)
    first[rank[order[::-1]]] = places[order[::-1]]
    for at in range(0, len(places), 1 << 16):
        some = slice(at, at + (1 << 16))
        shared = places[some] != first[rank[some]]
        if (grams[places[some][shared]] != grams[first[rank[some][shared]]]).any():
            return np.unique(grams[places], axis=0, return_inverse=True)[1].ravel()  # a hash of two different symbols
    return rank


def repeated_starts(stretches: list[bytes], length: int) -> list[np.ndarray]:
    """For each of some different stretches, which of its strings of so many bytes are in another stretch, or twice in it."""
    sizes = np.array([len(s) for s in stretches])
    text = np.frombuffer(b"".join(s + b"\0" for s in stretches), np.uint8)
    starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    hashes = np.zeros(len(text), np.uint64)
    hashes[: len(text) - STEP + 1] = Grams(len(text)).hashes(text, STEP)
    inner = np.ones(len(text), bool)
    inner[(np.repeat(starts + sizes, STEP).reshape(-1, STEP) - np.arange(STEP)).ravel()] = False
    symbols = np.zeros(len(text), np.int64)
    symbols[inner] = symbols_of(text, np.flatnonzero(inner), hashes[inner]) + 1
    cut = len(stretches) // 2
    at = int(starts[cut])
    a, b = Shard(starts[:cut], sizes[:cut], symbols[:at]), Shard(starts[cut:] - at, sizes[cut:], symbols[at:])
    from_b, apart = merge(a, b, length // STEP)
    place = np.empty(len(text), np.int64)
    place[~from_b], place[from_b] = a.order, b.order + at
    twice = ~apart
    twice[:-1] |= ~apart[1:]
    found = np.zeros(len(text), bool)
    found[place[twice]] = True
    return [found[s : s + n - length + 1] for s, n in zip(starts.tolist(), sizes.tolist(), strict=True)]


def spans_of(found: np.ndarray, first: int, length: int) -> list[tuple[int, int]]:
    """Byte spans (start, end) that the strings starting at the marked places cover, merged."""
    out: list[tuple[int, int]] = []
    for at in (np.flatnonzero(found) + first).tolist():
        if out and at <= out[-1][1]:
            out[-1] = out[-1][0], at + length
        else:
            out.append((at, at + length))
    return out


def _digest(text: bytes, place: int, first: int, last: int, length: int) -> bytes:
    return hashlib.blake2b(text[first : last + length], digest_size=16, salt=(place - first).to_bytes(2, "little")).digest()


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    for at in range(0, batch.num_rows, 500):
        yield from zip(*(c.to_pylist() for c in batch.slice(at, 500).columns), strict=True)


def _batch(ddl: str, rows: list[tuple]) -> pa.RecordBatch:
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    names, kinds = zip(*(x.split() for x in ddl.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, types[k]) for c, k in zip(columns, kinds, strict=True)], names=list(names))


def _with_lists(texts: DataFrame, lists: DataFrame) -> DataFrame:
    """texts (id, text_hash, text) with the documents' lists (id, text_hash, held); lists is a written table."""
    named = lists.select(F.col("id").alias("l_id"), F.col("text_hash").alias("l_hash"), "held")
    side = named.hint("shuffle_hash")  # as long as the corpus, so never broadcast
    return texts.join(side, texts["id"].eqNullSafe(side["l_id"]) & texts["text_hash"].eqNullSafe(side["l_hash"]), "left").select("id", "text_hash", "text", "held")


STRETCHES = "id long, text_hash long, hash long, first int, run int, digest binary"
SPANS = "id long, text_hash long, start int, end int"


#: A stretch as it is dealt to the owner of its anchor's hash; none: the document's doc_id is null.
STRETCH = np.dtype([("hash", np.uint64), ("id", np.int64), ("text_hash", np.int64), ("first", np.int32), ("run", np.int32), ("digest", "V16"), ("none", bool)])
#: A string of a stretch: its hash, the stretch's number and the string's place in it.
STRING = np.dtype([("hash", np.uint64), ("number", np.int64), ("at", np.int32)])


def _stretches(records: np.ndarray) -> pa.RecordBatch:
    digest = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(records), [None, pa.py_buffer(np.ascontiguousarray(records["digest"]).tobytes())]).cast(pa.binary())
    id_ = pa.array(records["id"], pa.int64(), mask=records["none"])
    longs = [pa.array(x, pa.int64()) for x in (records["text_hash"], np.ascontiguousarray(records["hash"]).view(np.int64))]
    return pa.RecordBatch.from_arrays([id_, *longs, *[pa.array(records[c], pa.int32()) for c in ("first", "run")], digest], names=[x.split()[0] for x in STRETCHES.split(", ")])


def suspects(texts: DataFrame, length: int) -> DataFrame:
    """The stretches whose anchor's hash is in the twice-seen filter."""
    size = texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    segments = bloom.segments_of(size * 2 // (length - GRAM + 2))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        grams = Grams(BLOCK + length)
        for batch in batches:
            for doc_id, text_hash, text in _rows(batch):
                for hashes, places, first, last in anchors(text or b"", length, grams):
                    out = np.zeros(len(hashes), STRETCH)
                    digests = b"".join([_digest(text, p, f, e, length) for p, f, e in zip(places.tolist(), first.tolist(), last.tolist(), strict=True)])
                    out["hash"], out["id"], out["text_hash"], out["first"], out["run"] = hashes, doc_id or 0, text_hash, first, last - first + 1
                    out["digest"], out["none"] = np.frombuffer(digests, "V16"), doc_id is None
                    yield out

    dealt = texts.mapInArrow(lambda batches: bloom.dealt(records(batches), segments), bloom.DEALT)
    return bloom.suspects(dealt, STRETCH, _stretches, STRETCHES)


CUTS = "id long, text_hash long, hash long, first int, times long, stretch binary"


def shrunk(wide: DataFrame, length: int) -> DataFrame:
    """The runs of strings of the stretches (CUTS and a number) that may be repeated: as stretches, with their digest."""
    n = wide.agg(F.coalesce(F.sum((F.length("stretch") - length + 1) * F.least("times", F.lit(2))), F.lit(0))).first()[0]
    segments = bloom.segments_of(n)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            for number, times, s in _rows(batch):
                out = np.zeros(len(s) - length + 1, STRING)
                out["hash"] = np.frombuffer(b"".join([hashlib.blake2b(s[i : i + length], digest_size=8).digest() for i in range(len(out))]), np.uint64)
                out["number"], out["at"] = number, np.arange(len(out))
                yield out if times == 1 else np.repeat(out, 2)

    def places(records: np.ndarray) -> pa.RecordBatch:
        """One row for each stretch, with the places of its strings."""
        records = records[np.argsort(records["number"], kind="stable")]
        cuts = np.flatnonzero(np.concatenate(([True], records["number"][1:] != records["number"][:-1]))) if len(records) else np.zeros(0, np.int64)
        held = pa.ListArray.from_arrays(pa.array(np.append(cuts, len(records)), pa.int32()), pa.array(records["at"], pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(records["number"][cuts], pa.int64()), held], names=["number", "held"])

    dealt = wide.select("number", "times", "stretch").mapInArrow(lambda batches: bloom.dealt(records(batches), segments), bloom.DEALT)
    found = bloom.suspects(dealt, STRING, places, "number long, held array<int>")
    found = found.groupBy("number").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("held")))).alias("held"))
    found = written(found.withColumnRenamed("number", "s_number"), "hot-strings")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text_hash, h, first, times, s, held in _rows(batch):
                for start, end in spans_of(np.isin(np.arange(len(s) - length + 1), held), 0, 1):
                    part = s[start : end + length - 1]
                    out.append((doc_id, text_hash, h, first + start, times, part, hashlib.blake2b(part, digest_size=16).digest()))
            yield _batch(f"{CUTS}, digest binary", out)

    joined = wide.join(found.hint("shuffle_hash"), F.col("number") == F.col("s_number"))
    return joined.select([c.split()[0] for c in CUTS.split(", ")] + ["held"]).mapInArrow(runs, f"{CUTS}, digest binary")


def solve_buckets(cuts: DataFrame, length: int) -> DataFrame:
    """SPANS of the strings that stretches (CUTS, all different) with equal anchor hashes share; of stretches that occur once."""
    total = cuts.agg(F.coalesce(F.sum(F.length("stretch")), F.lit(0))).first()[0]

    def solved(held: list[tuple]) -> pa.RecordBatch:
        found = repeated_starts([x[-1] for x in held], length)
        return _batch(SPANS, [(i, h, s, e) for (_, i, h, first, times, _), marks in zip(held, found, strict=True) if times == 1 for s, e in spans_of(marks, first, length)])

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in _rows(batch):
                if held and row[0] != held[0][0]:
                    yield solved(held)
                    held = []
                held.append(row)
        if held:
            yield solved(held)

    dealt = cuts.select(F.pmod(F.xxhash64("hash"), F.lit(max(1, -(-total // BUCKET_BYTES)))).alias("bucket"), "id", "text_hash", "first", "times", "stretch")
    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(bucket, SPANS)


def solve_strings(cuts: DataFrame, length: int) -> DataFrame:
    """As solve_buckets, by one digest for each string: those that occur once are found by counting, the rest repeats."""
    wide = cuts.withColumn("last", F.length("stretch") - length)
    strings = wide.select("id", "text_hash", "first", "times", F.posexplode(F.transform(F.sequence(F.lit(0), "last"), lambda i: F.unhex(F.md5(F.substring("stretch", i + 1, F.lit(length)))))).alias("i", "string"))
    once = strings.groupBy("string").agg(F.sum("times").alias("n"), F.first(F.struct("id", "text_hash", "first", "i")).alias("at")).where("n = 1")
    once = once.groupBy("at.id", "at.text_hash", "at.first").agg(F.collect_list("at.i").alias("lone")).select(F.col("id").alias("o_id"), F.col("text_hash").alias("o_hash"), F.col("first").alias("o_first"), "lone")
    joined = wide.where("times = 1").join(once, F.col("id").eqNullSafe(F.col("o_id")) & F.col("text_hash").eqNullSafe(F.col("o_hash")) & (F.col("first") == F.col("o_first")), "left")
    again = F.array_except(F.sequence(F.lit(0), "last"), F.coalesce("lone", F.array().cast("array<int>")))
    spans = F.transform(again, lambda i: F.struct((F.col("first") + i).alias("start"), (F.col("first") + i + length).alias("end")))
    return joined.select("id", "text_hash", F.explode(spans).alias("s")).select("id", "text_hash", "s.start", "s.end")


def with_anchor_size(kinds: DataFrame) -> DataFrame:
    """The stretches (hash, times, ...) that share their anchor hash with a different one, with hot (over HOT of them)."""
    shared = written(kinds.groupBy("hash").agg(F.count(F.lit(1)).alias("group_rows")).where("group_rows > 1"), "stretch-anchors")
    return attach(kinds, shared, "hash", F.col("digest"), kinds.count(), "inner").withColumn("hot", F.col("group_rows") > HOT).drop("group_rows")


def repeated_spans(texts: DataFrame, length: int = 200) -> DataFrame:
    """id, text_hash, held: byte spans (start, end) of each document that repeated strings cover; they may overlap."""
    stretches = written(suspects(texts, length), "stretches")
    kinds = stretches.groupBy("digest").agg(F.first("hash").alias("hash"), F.count(F.lit(1)).alias("times"), F.min(F.struct("id", "text_hash", "first", "run")).alias("at"))
    kinds = written(kinds, "stretch-kinds")
    # 2. stretches that occur twice
    twice = kinds.where("times > 1").select("digest", F.col("times").alias("group_rows"))
    whole = attach(stretches, twice, "digest", F.struct("id", "first"), stretches.count(), "inner")
    whole = whole.select("id", "text_hash", F.col("first").alias("start"), (F.col("first") + F.col("run") + length - 1).alias("end"))
    # 3. those that share their anchor with different ones
    mixed = with_anchor_size(kinds).select("hash", "times", "at.*", "hot")
    wanted = written(mixed.groupBy("id", "text_hash").agg(F.collect_list(F.struct("hash", "first", "run", "times", "hot")).alias("held")), "stretch-wanted")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                out = [(i, h, x["hash"], x["first"], x["times"], t[x["first"] : x["first"] + x["run"] + length - 1], int(x["hot"])) for i, h, t, held in _rows(batch.slice(at, 500)) for x in held]
                yield _batch(f"{CUTS}, hot int", out)

    cuts = written(_with_lists(texts, wanted).where(F.col("held").isNotNull()).mapInArrow(cut, f"{CUTS}, hot int"), "stretch-bytes")
    spans = whole.unionByName(solve_buckets(cuts.where("hot = 0").drop("hot"), length))
    # 4. hot anchors
    hot = cuts.where("hot = 1").drop("hot")
    if hot.limit(1).count():
        wide = written(hot.withColumn("number", F.monotonically_increasing_id()), "hot-numbered")
        parts = written(shrunk(wide, length), "hot-stretches")
        kinds = parts.groupBy("digest").agg(F.first("hash").alias("hash"), F.sum("times").alias("times"), F.min(F.struct("id", "text_hash", "first")).alias("at"), F.first("stretch").alias("stretch"))
        kinds = written(kinds, "hot-kinds")
        again = attach(parts.drop("times"), kinds.where("times > 1").select("digest", F.col("times").alias("group_rows")), "digest", F.struct("id", "first"), parts.count(), "inner")
        again = again.select("id", "text_hash", F.col("first").alias("start"), (F.col("first") + F.length("stretch")).alias("end"))
        left = written(with_anchor_size(kinds).select("at.id", "at.text_hash", "hash", "at.first", "times", "stretch", "hot"), "hot-mixed")
        spans = spans.unionByName(again).unionByName(solve_buckets(left.where("not hot").drop("hot"), length)).unionByName(solve_strings(left.where("hot").drop("hot"), length))
    return spans.groupBy("id", "text_hash").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("held"))


def cut_spans(text: bytes, spans: list) -> tuple[bytes, int, int]:
    """The bytes outside sorted spans, the bytes removed, and the number of removed runs."""
    kept, at, runs, end = [], 0, 0, -1
    for s in spans:
        if s["start"] > end:
            kept.append(text[max(at, 0) : s["start"]])
            runs += 1
        end = max(end, s["end"])
        at = end
    kept.append(text[at:])
    left = b"".join(kept)
    return left, len(text) - len(left), runs


def remove_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    texts = _texts(docs)
    held = written(repeated_spans(texts, length), "repeat-spans")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
        for batch in batches:
            out = []
            for doc_id, _, text, spans in _rows(batch):
                left, removed, runs = cut_spans(text or b"", spans or [])
                out.append((doc_id, len(text or b""), removed, runs, hashlib.sha256(left).hexdigest()))
            yield _batch(ddl, out)

    return _with_lists(texts, held).mapInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
