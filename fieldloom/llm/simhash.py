"""Near-duplicates by SimHash fingerprints, searched with BK-trees.

Equal fingerprints are one node. By the pigeonhole principle two fingerprints within the radius agree on one of
`radius + 1` blocks of bits, so the nodes are sharded by every block and its value; a shard of over SHARD nodes is sharded
again by blocks of the bits that it leaves free, up to LEVELS times, after which few bits are free and its size is bounded.
Each shard has a BK-tree: children hang under their integer Hamming distance to the parent, and a search follows only the
edges within the radius. Together the trees grow with the corpus, which rules out a broadcast of all of them (see README);
each goes to the task that searches it. A shard yields a spanning forest rather than all its pairs: found nodes leave the
search, so a dense group costs one search a node. The forests are joined by components().

similar_documents() links texts by their shingles instead. Two texts are similar if the Jaccard similarity of their sets
of shingles, or the share of their words that stand in shingles of the other, is high enough. The second is at least
about the first, and it holds where single words were edited throughout, each of which breaks as many shingles as one has
words. Fingerprints of such texts differ in up to 26 of 64 bits, where the pigeonhole principle gives no useful shards, so
shards are texts that share a band of minimum hashes: one from each half of the text, or several of the whole. A shard's
BK-tree proposes pairs within WIDE bits and the whole sequences of shingles decide them, all proposals of a text at once. Bands are taken in rounds: a shard whose texts are in one group already is
skipped. A shard larger than a tree has several; their largest groups meet first, and then only texts outside the
shard's main group ask the other trees, so that a dense group does not compare all its pairs.

Defined cases: null and empty texts have fingerprint zero and link like any other; by similarity, texts without words are
one group and a text of fewer words than a shingle is one shingle. A null doc_id never is a component's id unless all its
members are null. Repeated rows share a component. Very long texts are hashed in blocks. Other columns may have any names;
empty tables give none.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, per_row, small_enough, without, written
from .components import components

#: Nodes of a fingerprint shard, and how often a larger one is sharded again; then at most 23 bits are free.
SHARD, LEVELS = 256, 5
#: Texts of a tree, and shingles that they hold.
TREE, TREE_SHINGLES = 4096, 1 << 21
#: Shingles hashed at once.
BLOCK = 1 << 16
#: Bands of one minimum hash of a text's first half and one of its second: of pairs with a Jaccard similarity of 0.5 (0.4)
#: 99.7 (97) of 100 share one. Copies edited throughout agree in both halves; texts that only share a passage seldom do.
#: Bands of several minimum hashes of the whole text, for similar texts whose parts moved. The first ROUND bands find
#: nearly all pairs of 0.8.
HALVES, WHOLE, WHOLE_ROWS, ROUND = 20, 8, 5, 5
BANDS = HALVES + WHOLE
#: Fingerprints of similar texts lie within so many bits (at a Jaccard similarity of 0.5 the mean is 17, the deviation 3.6).
WIDE = 26


def shingle_hashes(text: bytes | None, shingle: int) -> Iterator[np.ndarray]:
    """The XXH64 hashes of a text's shingles, repeats included, in blocks; none for a text without words."""
    words = (text or b"").lower().split()
    if not words:
        return
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    starts, ends = starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist()
    for at in range(0, n, BLOCK):
        yield np.array([h(joined[s:e], 42) for s, e in zip(starts[at : at + BLOCK], ends[at : at + BLOCK], strict=True)], np.uint64)


def majority(blocks: Iterable[np.ndarray]) -> int:
    """Bit i is set if it is set in over half of the hashes."""
    counts, n = np.zeros(64, np.int64), 0
    for hashes in blocks:
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes | None, shingle: int = 4) -> int:
    """The SimHash of a text: bit i is set if it is set in over half of the shingles' XXH64 hashes."""
    return majority(shingle_hashes(text, shingle))


class Sketch:
    """A text's shingle hashes, in order and as a sorted set."""

    def __init__(self, text: bytes | None, shingle: int):
        self.sequence = np.concatenate([np.empty(0, np.uint64), *shingle_hashes(text, shingle)])
        self.set, self.shingle = np.unique(self.sequence), shingle

    def words_in(self, other: Sketch) -> tuple[int, int]:
        """How many words stand in shingles of the other text, and how many there are; a short text counts as one word."""
        if not len(self.sequence):
            return 0, 0
        n = len(self.sequence)
        held = other.set[np.minimum(np.searchsorted(other.set, self.sequence), len(other.set) - 1)] == self.sequence if len(other.set) else np.zeros(n, bool)
        width = self.shingle if n > 1 else 1
        steps = np.zeros(n + width, np.int64)
        steps[:n] += held
        steps[width:] -= held
        return int((np.cumsum(steps) > 0).sum()), n + width - 1

    def like(self, other: Sketch, similarity: float) -> bool:
        """Whether the texts have at least this similarity; two without words do."""
        both = np.concatenate([self.set, other.set])
        both.sort(kind="stable")
        shared = int((both[1:] == both[:-1]).sum())
        if shared >= similarity * (len(both) - shared):
            return True
        if not shared:
            return False
        (a, n), (b, m) = self.words_in(other), other.words_in(self)
        return a + b >= similarity * (n + m)


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, text_hash, fp (the fingerprint as a signed long)."""
    made = lambda texts: [[x - (1 << 64) if (x := fingerprint(t, shingle)) >> 63 else x for t in texts]]
    return per_row(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").alias("text")), "text", made, {"fp": pa.int64()}, "fp long")


class Tree:
    """A BK-tree over distinct 64-bit fingerprints whose nodes can leave the search."""

    def __init__(self, fps: list[int]):
        self.fps, self.kids, self.parent, self.live = fps, [{} for _ in fps], [-1] * len(fps), [1] * len(fps)
        for i in range(1, len(fps)):
            at, fp = 0, fps[i]
            while True:
                self.live[at] += 1
                d = (fps[at] ^ fp).bit_count()
                if (kid := self.kids[at].get(d)) is None:
                    self.kids[at][d], self.parent[i] = i, at
                    break
                at = kid
        self.out = [False] * len(fps)

    def leave(self, i: int) -> None:
        self.out[i] = True
        while i >= 0:
            self.live[i] -= 1
            i = self.parent[i]

    def near(self, fp: int, radius: int) -> list[int]:
        """The nodes within the radius that have not left."""
        found, todo = [], [0] if self.fps else []
        while todo:
            at = todo.pop()
            if not self.live[at]:
                continue
            d = (self.fps[at] ^ fp).bit_count()
            if d <= radius and not self.out[at]:
                found.append(at)
            todo += [kid for e, kid in self.kids[at].items() if d - radius <= e <= d + radius]
        return found

    def forest(self, radius: int) -> tuple[list[tuple[int, int]], list[int]]:
        """Edges that span the components among the nodes, and each node's root."""
        edges, root = [], [-1] * len(self.fps)
        for start in range(len(self.fps)):
            if root[start] >= 0:
                continue
            root[start], todo = start, [start]
            self.leave(start)
            while todo:
                for i in self.near(self.fps[todo.pop()], radius):
                    self.leave(i)
                    root[i] = start
                    edges.append((i, start))
                    todo.append(i)
        return edges, root


def _masks(level: int, radius: int) -> list[int]:
    """For each way to choose a block of the free bits so many times, the bits that are held equal."""
    masks = [0]
    for _ in range(level):
        more = []
        for mask in masks:
            free = [i for i in range(64) if not mask >> i & 1]
            cuts = [len(free) * i // (radius + 1) for i in range(radius + 2)]
            more += [mask | sum(1 << i for i in free[cuts[k] : cuts[k + 1]]) for k in range(radius + 1)]
        masks = more
    return masks


def links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """Edges a, b between distinct fingerprints (fp) that join the same components as all pairs within the radius."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    large, done = fps.select("fp", F.lit(0).alias("path")), None
    for level in range(1, LEVELS + 1):
        masks = F.array(*[F.lit(signed(m)).cast("long") for m in _masks(level, radius)])
        nodes = large.select("fp", F.explode(F.sequence(F.col("path") * (radius + 1), F.col("path") * (radius + 1) + radius)).alias("path"))
        nodes = written(nodes.withColumn("key", F.xxhash64("path", F.col("fp").bitwiseAND(masks[F.col("path")]))), "simhash-nodes")
        sizes = written(nodes.groupBy("key").agg(F.count(F.lit(1)).alias("group_rows")).where("group_rows > 1"), "simhash-shards")
        nodes = written(attach(nodes, sizes, "key", F.col("fp"), nodes.count(), "inner"), "simhash-sized")
        fits = F.lit(True) if level == LEVELS else F.col("group_rows") <= SHARD
        some = nodes.where(fits).select(F.xxhash64("key", F.lit(level)).alias("key"), "fp")
        done = some if done is None else done.unionByName(some)
        large = nodes.where(~fits).select("fp", "path")
        if not large.limit(1).count():
            break

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members, a, b = None, [], [], []

        def spanned() -> None:
            edges, _ = Tree(members).forest(radius)
            a.extend(members[i] for i, _ in edges)
            b.extend(members[j] for _, j in edges)

        for batch in batches:
            for shard, fp in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                if shard != key:
                    spanned()
                    key, members = shard, []
                members.append(fp & ((1 << 64) - 1))
            yield _edges(a, b)
            a, b = [], []
        spanned()
        yield _edges(a, b)

    return done.repartition("key").sortWithinPartitions("key").mapInArrow(search, "a long, b long")


def _edges(a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a, b)], names=["a", "b"])


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """Per document: doc_id, text_hash, fingerprint (16 hex digits), component_id, first (the member that stands for the
    component: its smallest doc_id, nulls last), class_nodes (distinct fingerprints in the component)."""
    rows = written(fingerprints(docs, shingle), "simhash")
    member = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_hash"))
    nodes = written(rows.groupBy("fp").agg(F.min(member).alias("least"), F.count(F.lit(1)).alias("fp_rows")), "simhash-nodes")
    roots = written(components(links(nodes.select("fp"), radius)), "simhash-roots")
    known = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", "fp_rows", F.coalesce("root", "fp").alias("root"))
    classes = known.groupBy("root").agg(F.min("least").alias("first"), F.count(F.lit(1)).alias("group_rows"))
    classes = written(classes.withColumn("class_nodes", F.col("group_rows")), "simhash-classes")
    table = attach(known, classes, "root", F.col("fp"), nodes.count()).select("fp", "first", "class_nodes", F.col("fp_rows").alias("group_rows"))
    out = attach(rows, written(table, "simhash-table"), "fp", F.struct("doc_id", "text_hash"), rows.count())
    return out.select("doc_id", "text_hash", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.id").alias("component_id"), "first", "class_nodes")


def keep_one(docs: DataFrame, shingle: int = 5, radius: int = 4) -> DataFrame:
    """docs with one document of each group of near-duplicates, that with the smallest doc_id; columns stay as they are."""
    return _first_of(docs, near_duplicates(docs, shingle, radius))


def _first_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    stays = F.col("doc_id").eqNullSafe(F.col("first.id")) & (F.col("text_hash") == F.col("first.text_hash"))
    marks = ids.groupBy(F.col("doc_id").alias("id"), "text_hash").agg(F.max(stays).alias("stays"), F.count(F.lit(1)).alias("n"))
    return without(docs, written(marks.where("n > 1 or not stays"), "simhash-marks"))


_ODD, _ADD = (np.random.default_rng(7).integers(0, 1 << 63, (2, HALVES * 2 + WHOLE * WHOLE_ROWS), np.uint64) * np.uint64(2) + np.uint64(1))


def least_hashes(hashes: np.ndarray, first: int, last: int) -> np.ndarray:
    """The minimum of a text's shingles under each of some hash functions."""
    least = np.full(last - first, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        np.minimum(least, (hashes[at : at + 4096, None] * _ODD[first:last] + _ADD[first:last]).min(axis=0), out=least)
    return least


def band_keys(sequence: np.ndarray) -> list[int]:
    """One signed 64-bit key for each band of a text's shingles."""
    middle = len(sequence) // 2
    halves = least_hashes(sequence[:middle] if middle else sequence, 0, HALVES), least_hashes(sequence[middle:], HALVES, 2 * HALVES)
    bands = [*np.stack(halves, axis=1), *least_hashes(sequence, 2 * HALVES, len(_ODD)).reshape(WHOLE, WHOLE_ROWS)]
    return [xxhash.xxh64_intdigest(band.tobytes(), i) - (1 << 63) for i, band in enumerate(bands)]


def sketches(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """doc_id, text_hash, row_hash, node (digest of the sequence of shingles), fp (SimHash of their set), shingles, bands."""

    def made(texts: list[bytes | None]) -> list[list]:
        out = [[], [], [], []]
        for text in texts:
            own = Sketch(text, shingle)
            out[0].append(xxhash.xxh64_intdigest(own.sequence.tobytes()) - (1 << 63))
            out[1].append(np.array([majority([own.set])], np.uint64).view(np.int64)[0])
            out[2].append(len(own.sequence))
            out[3].append(band_keys(own.sequence))
        return out

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.xxhash64(F.col("doc_id").cast("long"), "text").alias("row_hash"), F.col("text").alias("text"))
    return per_row(rows, "text", made, {"node": pa.int64(), "fp": pa.int64(), "shingles": pa.int64(), "bands": pa.list_(pa.int64())}, "node long, fp long, shingles long, bands array<long>")


def _pairs(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    made = pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], names=["a", "b"])
    edges.clear()
    return made


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Lists of rows; the last column holds texts, as bytes."""
    for batch in batches:
        for at in range(0, batch.num_rows, 100):
            part = batch.slice(at, 100)
            *others, texts = part.columns
            yield list(zip(*(x.to_pylist() for x in others), texts.cast(pa.binary()).to_pylist(), strict=True))


class Members:
    """The texts of a tree: a BK-tree over their distinct fingerprints proposes, and whole sequences of shingles decide.

    A search goes down the tree a level at a time, and a text is held against all that it proposes at once: shingles get
    numbers within the tree, and marking those of the text in an array tells which of the others' shingles it shares."""

    def __init__(self, fps: list[int], sketches: list[Sketch], shingle: int):
        self.shingle, self.width = shingle, shingle - 1
        self.fps, self.at = np.unique(np.array(fps, np.uint64), return_inverse=True)
        # sorted fingerprints would make a lopsided tree
        order = np.argsort(self.fps * np.uint64(0x9E3779B97F4A7C15))
        tree, back = Tree([int(self.fps[i]) for i in order]), np.argsort(order)
        self.fps, self.at = self.fps[order], back[self.at]
        self.n_kids = np.array([len(k) for k in tree.kids])
        self.first_kid = np.cumsum(self.n_kids) - self.n_kids
        self.kids = np.array([i for k in tree.kids for i in k.values()], np.int64)
        self.edges = np.array([e for k in tree.kids for e in k], np.int64)
        self.parent = tree.parent
        self.here = np.bincount(self.at, minlength=len(self.fps))
        below = self.here.copy()
        for i in range(len(below) - 1, 0, -1):
            below[self.parent[i]] += below[i]
        self.live = below
        self.by_node = np.argsort(self.at, kind="stable")
        self.first_member, self.n_members = np.cumsum(self.here) - self.here, self.here.copy()
        self.out = np.zeros(len(fps), bool)
        # shingles by number: each text's set, and its sequence followed by as many blanks as the next text's words could reach
        self.values, numbers = np.unique(np.concatenate([x.set for x in sketches]), return_inverse=True)
        self.blank = len(self.values)
        self.sizes = np.array([len(x.set) for x in sketches])
        self.set_at, self.sets = np.cumsum(self.sizes) - self.sizes, numbers.astype(np.int32)
        blanks = np.full(self.width, self.blank, np.int32)
        self.length = np.array([len(x.sequence) for x in sketches])
        self.words = np.where(self.length > 1, self.length + self.width, self.length)
        self.sequences = np.concatenate([part for x in sketches for part in (np.searchsorted(self.values, x.sequence).astype(np.int32), blanks)])
        self.sequence_at = np.cumsum(self.length + self.width) - self.length - self.width
        self.marks, self.place = np.zeros(self.blank + 1, bool), np.zeros(self.blank + 1, np.int32)

    def leave(self, i: int) -> None:
        self.out[i] = True
        node = self.at[i]
        self.here[node] -= 1
        while node >= 0:
            self.live[node] -= 1
            node = self.parent[node]

    def near(self, fp: int, radius: int) -> np.ndarray:
        """The members within the radius that have not left."""
        found, level, fp = [], np.zeros(1, np.int64), np.uint64(fp)
        while len(level := level[self.live[level] > 0]):
            far = np.bitwise_count(self.fps[level] ^ fp).astype(np.int64)
            found.append(level[(far <= radius) & (self.here[level] > 0)])
            kids = _runs(self.first_kid[level], self.n_kids[level])
            level = self.kids[kids[np.abs(self.edges[kids] - np.repeat(far, self.n_kids[level])) <= radius]]
        if not found:
            return level
        nodes = np.concatenate(found)
        some = self.by_node[_runs(self.first_member[nodes], self.n_members[nodes])]
        return some[~self.out[some]]

    def like(self, own: Sketch, others: np.ndarray, similarity: float) -> np.ndarray:
        """Sketch.like of the text and each of the other members."""
        held = np.searchsorted(self.values, own.set)
        known = held < self.blank
        known[known] = self.values[held[known]] == own.set[known]
        held = held[known]
        self.marks[held] = True
        at, n = self.set_at[others], self.sizes[others]
        shared = self._sums(self.sets, at, n)
        alike = shared >= similarity * (len(own.set) + n - shared)
        own_length = len(own.sequence)
        own_words = own_length + self.width if own_length > 1 else own_length
        words = self.words[others]
        # a shared shingle, or a repeat of one, covers as many words as a shingle has
        most_own = np.minimum(own_words, self.shingle * (shared + own_length - len(own.set)))
        most = np.minimum(words, self.shingle * (shared + self.length[others] - n))
        open_ = np.flatnonzero(~alike & (shared > 0) & (most_own + most >= similarity * (own_words + words)))
        if len(open_):
            covered = self._covered(others[open_])
            may = most_own[open_] + covered >= similarity * (own_words + words[open_])
            open_, covered = open_[may], covered[may]
            self.place[held] = np.flatnonzero(known)
            sequence = np.searchsorted(own.set, own.sequence)
            step = max(1, (1 << 22) // own_words)
            for i in range(0, len(open_), step):
                some = open_[i : i + step]
                which = _runs(self.set_at[others[some]], self.sizes[others[some]])
                row, number = np.repeat(np.arange(len(some)), self.sizes[others[some]]), self.sets[which]
                row, number = row[self.marks[number]], number[self.marks[number]]
                has = np.zeros((len(some), len(own.set)), bool)
                has[row, self.place[number]] = True
                flags = np.zeros((len(some), own_words + 1), np.int32)
                flags[:, 1 : own_length + 1] = has[:, sequence]
                flags = np.cumsum(flags, axis=1, dtype=np.int32)
                width = self.shingle if own_length > 1 else 1
                reach = flags[:, 1:].copy()
                reach[:, width - 1 :] -= flags[:, : own_words - width + 1]
                alike[some] = (reach > 0).sum(axis=1) + covered[i : i + step] >= similarity * (own_words + words[some])
        self.marks[held] = False
        return alike

    def _sums(self, numbers: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """How many of each run of numbers are marked."""
        if 3 * n.sum() < len(numbers):
            numbers, at = numbers[_runs(at, n)], np.cumsum(n) - n
        sums = np.concatenate(([0], np.cumsum(self.marks[numbers], dtype=np.int32)))
        return sums[at + n] - sums[at]

    def _covered(self, others: np.ndarray) -> np.ndarray:
        """How many words of each member stand in marked shingles."""
        sequences, at, n = self.sequences, self.sequence_at[others], self.length[others] + self.width
        if 3 * n.sum() < len(sequences):
            sequences, at = sequences[_runs(at, n)], np.cumsum(n) - n
        flags = np.concatenate(([0], np.cumsum(self.marks[sequences], dtype=np.int32)))
        reach = flags[1:].copy()
        reach[self.shingle :] -= flags[1 : -self.shingle]
        sums = np.concatenate(([0], np.cumsum(reach > 0, dtype=np.int32)))
        found = sums[at + n] - sums[at]
        return np.where(self.length[others] > 1, found, np.minimum(found, 1))


def _runs(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers from each first on, so many of each."""
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


def spanning(rows: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Edges a, b between the groups that similar texts of each tree were in. rows: key, tree, root (the group), fp, text, sorted by tree."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, members, edges = None, [], []

        def spanned() -> None:
            if len(members) < 2:
                return
            tree = Members([m[1] for m in members], [m[2] for m in members], shingle)
            for start in range(len(members)):
                if tree.out[start]:
                    continue
                tree.leave(start)
                todo = [start]
                while todo:
                    at = todo.pop()
                    some = tree.near(members[at][1], WIDE)
                    for i in some[tree.like(members[at][2], some, similarity)].tolist() if len(some) else ():
                        tree.leave(i)
                        if members[i][0] != members[at][0]:
                            edges.append((members[i][0], members[at][0]))
                        todo.append(i)

        for some in _read(batches):
            for key, tree, root, fp, text in some:
                if (key, tree) != shard:
                    spanned()
                    shard, members = (key, tree), []
                members.append((root, fp & ((1 << 64) - 1), Sketch(text, shingle)))
            yield _pairs(edges)
        spanned()
        yield _pairs(edges)

    return rows.mapInArrow(search, "a long, b long")


def answers(rows: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Edges a, b from the group of each text that asks a tree to each other group in it with a member that it is similar to.

    rows: key, tree, asks (0: a member, 1: asks), root (the group of the text), fp, text; sorted, members first.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, members, tree, edges = None, [], None, []
        for some in _read(batches):
            for key, number, asks, root, fp, text in some:
                if (key, number) != shard:
                    shard, members, tree = (key, number), [], None
                fp &= (1 << 64) - 1
                own = Sketch(text, shingle)
                if not asks:
                    members.append((root, fp, own))
                    continue
                if tree is None:
                    tree = Members([m[1] for m in members], [m[2] for m in members], shingle)
                    groups = np.array([m[0] for m in members])
                some = tree.near(fp, WIDE)
                some = some[groups[some] != root]
                if len(some):
                    edges += [(root, group) for group in np.unique(groups[some[tree.like(own, some, similarity)]]).tolist()]
            yield _pairs(edges)

    return rows.mapInArrow(search, "a long, b long")


def _with_texts(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """rows with the text of their row_hash instead of it."""
    wanted = small_enough(written(rows.select(F.col("row_hash").alias("want")).distinct(), "simhash-wanted"))
    texts = docs.select(F.xxhash64(F.col("doc_id").cast("long"), "text").alias("row_hash"), F.col("text").alias("text"))
    texts = texts.join(wanted, texts["row_hash"] == wanted["want"], "left_semi").dropDuplicates(["row_hash"])
    return rows.join(texts, "row_hash").drop("row_hash")


def with_roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes with root, their group, merged by edges between groups."""
    merged = written(components(edges), "simhash-roots")
    groups = nodes.groupBy(F.col("root").alias("node")).agg(F.count(F.lit(1)).alias("group_rows")).join(merged, "node")
    table = groups.select(F.col("node").alias("root"), F.col("root").alias("into"), "group_rows")
    found = attach(nodes, table, "root", F.col("node"), nodes.count())
    return found.withColumn("root", F.coalesce("into", "root")).select(nodes.columns)


def band_links(docs: DataFrame, nodes: DataFrame, first: int, last: int, shingle: int, similarity: float) -> DataFrame:
    """Edges a, b between groups (roots) of nodes, which merge these as all similar pairs that share one of these bands do."""
    keys = nodes.select("node", "fp", "shingles", "row_hash", "root", F.explode(F.slice("bands", first + 1, last - first)).alias("key"))
    shards = keys.groupBy("key").agg(F.count(F.lit(1)).alias("group_rows"), F.sum("shingles").alias("load"), F.bit_xor(F.xxhash64("node")).alias("who"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("who_else"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    # bands with the same members are one shard
    shards = shards.groupBy("group_rows", "load", "who", "who_else").agg(F.min("key").alias("key"))
    trees = F.ceil(F.greatest(F.col("group_rows") / TREE, F.col("load") / TREE_SHINGLES)).cast("int")
    shards = written(shards.select("key", "group_rows", trees.alias("trees")), "simhash-shards")
    members = attach(keys, shards, "key", F.col("node"), nodes.count() * (last - first), "inner")
    own = F.pmod(F.xxhash64("node", "key"), F.col("trees")).cast("int")
    members = written(members.select("key", "trees", own.alias("tree"), "root", "node", "fp", "row_hash"), "simhash-members")
    rows = _with_texts(members.select("key", "tree", "root", "fp", "row_hash"), docs).select("key", "tree", "root", "fp", "text")
    edges = written(spanning(rows.repartition("key", "tree").sortWithinPartitions("key", "tree"), shingle, similarity), "simhash-edges")
    several = members.where("trees > 1")
    if not several.limit(1).count():
        return edges

    def asked(asks: DataFrame, several: DataFrame) -> DataFrame:
        columns = ["key", "tree", "asks", "root", "fp", "row_hash"]
        asks = written(asks.withColumn("asks", F.lit(1)).select(columns), "simhash-asks")
        wanted = asks.select("key", "tree").distinct()
        rows = several.withColumn("asks", F.lit(0)).select(columns).join(wanted, ["key", "tree"], "left_semi").unionByName(asks)
        rows = _with_texts(rows, docs).select(*columns[:-1], "text")
        return answers(rows.repartition("key", "tree").sortWithinPartitions("key", "tree", "asks"), shingle, similarity)

    grouped = lambda e: written(with_roots(several, e), "simhash-several")
    # the largest group of each tree asks the tree before it and the first one
    now = grouped(edges)
    sizes = now.groupBy("key", "tree", "root").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("node", "fp", "row_hash")).alias("one"))
    chief = sizes.groupBy("key", "tree").agg(F.max_by(F.struct("root", "one"), F.struct("n", "root")).alias("c")).where("tree > 0")
    chief = chief.select("key", F.explode(F.array_distinct(F.array(F.lit(0), F.col("tree") - 1))).alias("tree"), "c.root", "c.one.*")
    edges = written(edges.unionByName(asked(chief, now)), "simhash-edges")
    # texts outside a shard's main group ask all its other trees
    now = grouped(edges)
    main = now.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"))
    rest = now.join(main, "key").where("root <> main").withColumn("own", F.col("tree")).withColumn("tree", F.explode(F.sequence(F.lit(0), F.col("trees") - 1))).where("tree <> own")
    return written(edges.unionByName(asked(rest, now)), "simhash-edges")


def similar_documents(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """Per document: doc_id, text_hash, first (the member that stands for its group: the smallest doc_id, nulls last) and
    class_nodes (distinct sequences of shingles in the group). Groups are the components of the pairs of texts with at
    least this similarity."""
    rows = written(sketches(docs, shingle), "simhash-sketches")
    member = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_hash"), F.col("row_hash"))
    nodes = rows.groupBy("node").agg(F.min(member).alias("least"), F.first("fp").alias("fp"), F.first("shingles").alias("shingles"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("node_rows"))
    nodes = written(nodes.select("*", F.col("least.row_hash").alias("row_hash"), F.col("node").alias("root")), "simhash-texts")
    for first, last in ((0, ROUND), (ROUND, BANDS)):
        nodes = written(with_roots(nodes, band_links(docs, nodes, first, last, shingle, similarity)), "simhash-grouped")
    classes = nodes.groupBy("root").agg(F.min("least").alias("first"), F.count(F.lit(1)).alias("group_rows"))
    classes = written(classes.withColumn("class_nodes", F.col("group_rows")), "simhash-classes")
    table = attach(nodes.select("node", "root", "node_rows"), classes, "root", F.col("node"), nodes.count()).select("node", "first", "class_nodes", F.col("node_rows").alias("group_rows"))
    return attach(rows, written(table, "simhash-table"), "node", F.struct("doc_id", "text_hash"), rows.count()).select("doc_id", "text_hash", "first", "class_nodes")


def keep_similar_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one document of each group of similar texts (see similar_documents), that with the smallest doc_id; columns stay as they are."""
    return _first_of(docs, similar_documents(docs, shingle, similarity))
