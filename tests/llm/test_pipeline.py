"""Each stage of the pipeline against a brute-force version on its own input, and the whole against the chain of its stages."""

import random
import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from fieldloom.llm import decontaminate, language_id, line_dedup, mixture, simhash

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def chain(spark, sf_dir):
    """name: (input rows, output rows) of each stage."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, sf_dir)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert made.columns == docs.columns
        after = spark.createDataFrame(made.collect(), made.schema)
        out[name] = (docs.collect(), after.collect())
        docs = after
    return out


def ids(rows):
    return Counter(r.doc_id for r in rows)


def test_language_stage(spark, sf_dir, chain):
    before, after = chain["language_id"]
    seen = {r.doc_id: r for r in language_id.identify(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()}
    assert ids(after) == Counter(i for i, r in seen.items() if r.lang_pred != "und" and r.score >= 0.4)
    lettered = {r.doc_id for r in before if r.lang is not None and re.search(r"[^\W\d_]", r.text or "")}
    assert len(lettered - set(ids(after))) <= len(lettered) // 100
    assert not set(ids(after)) & {r.doc_id for r in before if not re.search(r"[^\W\d_]", r.text or "")}


def test_exact_stage(chain):
    before, after = chain["exact_dedup"]
    groups = defaultdict(list)
    for r in before:
        groups[(r.text or "").translate(LOWER)].append(r.doc_id)
    assert ids(after) == Counter(max(g) for g in groups.values())


def shingles(text):
    """The five-word shingles of a text, in order."""
    words = SPACED.findall((text or "").translate(LOWER))
    return [tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []


def words_in(a, b):
    """How many words of a stand in shingles of the set b, and how many there are."""
    width = 5 if len(a) > 1 else min(1, len(a))
    held = {i + k for i, x in enumerate(a) if x in b for k in range(width)}
    return len(held), len(a) + width - 1 if a else 0


def similar(a, b):
    """A Jaccard similarity, or a share of words in common shingles, of 0.8 or more."""
    sets = set(a), set(b)
    if 5 * len(sets[0] & sets[1]) >= 4 * len(sets[0] | sets[1]):
        return True
    (x, n), (y, m) = words_in(a, sets[1]), words_in(b, sets[0])
    return x + y > 0 and 5 * (x + y) >= 4 * (n + m)


def groups(texts):
    """The smallest id of each text's group: components of all similar pairs."""
    sets, root = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and find(i) != find(j) and similar(sets[i], sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in sets}


def test_near_stage(chain):
    before, after = chain["simhash_near_dedup"]
    assert ids(after) == Counter(i for i, first in groups({r.doc_id: r.text for r in before}).items() if i == first)


def edited(words, changes, rng):
    out = list(words)
    for at in rng.sample(range(len(out)), changes):
        out[at] = f"new{rng.randrange(10**9)}"
    return " ".join(out)


def test_near_copies_of_one_hot_text(spark, monkeypatch):
    """Copies with a few edits, some of them beyond the threshold, in a group that spans several trees."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    texts = [edited(base, rng.choice([0, 1, 2, 3, 6, 12, 40, 80]), rng) for _ in range(60)]
    texts += [" ".join(f"v{rng.randrange(10**6)}" for _ in range(rng.choice([1, 4, 60]))) for _ in range(40)]
    texts += [None, "", " \t", "a b", "A b", "x" * 10000, "long " * 30000, "long " * 29999, "\u00e9 \u00e8 " * 9]
    rows = [(i, t, "x", i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows + rows[:2] + [(None, texts[0], "y", 1)], "doc_id long, text string, node string, first long")
    want = groups(dict(enumerate(texts)))
    for tree in (4096, 16):
        monkeypatch.setattr(simhash, "TREE", tree)
        got = {r.doc_id: r.first.id for r in simhash.similar_documents(docs).collect() if r.doc_id is not None}
        assert got == want
    kept = simhash.keep_similar_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))
    assert simhash.keep_similar_one(docs.limit(0)).count() == 0


def test_members_of_a_tree_equal_pairs_one_by_one():
    """Proposals and decisions of a whole tree at once against each pair by itself."""
    rng = random.Random(5)
    base = [[rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(60)] for _ in range(3)]
    texts = [None, "", "one", "one", "one two three", "a b c d e", "a b c d e a b c d e a b c d e"]
    for _ in range(120):
        words = list(rng.choice(base))[: rng.choice((5, 6, 20, 60))]
        for _ in range(rng.randint(0, 12)):
            words[rng.randrange(len(words))] = rng.choice("xyz")
        texts.append(" ".join(words + words[: rng.choice((0, 0, 30))]))
    for shingle in (1, 2, 5):
        sketches = [simhash.Sketch(None if t is None else t.encode(), shingle) for t in texts]
        fps = [simhash.majority([x.set]) if len(x.set) else 0 for x in sketches]
        held = simhash.Members(fps, sketches, shingle)
        for i, own in enumerate(sketches):
            assert sorted(held.near(fps[i], 26).tolist()) == [j for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 26]
            for similarity in (0.3, 0.8):
                got = held.like(own, simhash.np.arange(len(fps)), similarity)
                assert got.tolist() == [own.like(x, similarity) for x in sketches]
        stranger = simhash.Sketch(b"words of no member at all but a b c d e", shingle)
        assert held.like(stranger, simhash.np.arange(len(fps)), 0.2).tolist() == [stranger.like(x, 0.2) for x in sketches]
        for i in range(0, len(fps), 2):
            held.leave(i)
        assert sorted(held.near(fps[8], 20).tolist()) == [j for j in range(1, len(fps), 2) if (fps[8] ^ fps[j]).bit_count() <= 20]
        for i in range(1, len(fps), 2):
            held.leave(i)
        assert not len(held.near(fps[8], 64))


def test_near_stage_catches_near_copies(spark):
    """Of all pairs at sf0.01 with a Jaccard similarity of 0.35 to under 1, at least 0.9 are in one group; pairs below are in none."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    first = {r.doc_id: r.first.id for r in simhash.similar_documents(docs).collect()}
    sets = {r.doc_id: set(shingles(r.text)) for r in docs.collect()}
    holders = defaultdict(list)
    for i, held in sets.items():
        for x in held:
            holders[x].append(i)
    shared = Counter()
    for some in holders.values():
        shared.update((a, b) for k, b in enumerate(some) for a in some[:k])
    caught = Counter()
    for (a, b), n in shared.items():
        jaccard = n / len(sets[a] | sets[b])
        if 0.35 <= jaccard < 1:
            caught[first[a] == first[b]] += 1
    assert sum(caught.values()) > 80 and caught[True] >= 0.9 * sum(caught.values())
    alone = {i for i in sets if sets[i]} - {i for pair, n in shared.items() for i in pair if n / len(sets[pair[0]] | sets[pair[1]]) >= 0.3}
    assert all(first[i] == i for i in alone) and len(alone) > 500


CLASHING = ("row", "id", "text_hash", "stays", "side_id", "gone", "shingles", "node", "fp", "mix_copy", "kept_words", "__text", "__id", "words", "key", "lang_pred")


def test_stages_keep_columns_with_clashing_names(spark, sf_dir):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    docs = docs.withColumns({c: F.lit(i) for i, c in enumerate(CLASHING)})
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        rows = out.collect()
        assert rows and all(r[c] == i for r in rows for i, c in enumerate(CLASHING) if c != "mix_copy"), name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
    assert {r.key for r in line_dedup.drop_repeated_lines(docs).collect()} == {CLASHING.index("key")}
    cut = decontaminate.cut_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    assert {r.row for r in cut.collect()} == {0} and cut.columns.count("kept_words") == 1


def test_stages_on_empty_tables(spark, sf_dir):
    docs = spark.createDataFrame([], spark.read.parquet(f"{sf_dir}/documents.parquet").schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_benchmark_stage(spark, sf_dir, chain):
    before, after = chain["decontamination"]
    windows = set()
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        words = WORDS.findall((r.text or "").translate(LOWER))
        windows |= {tuple(words[i : i + 10]) for i in range(max(1, len(words) - 9))} if words else set()
    sizes = {len(w) for w in windows}

    def hit(text):
        words = WORDS.findall((text or "").translate(LOWER))
        return any(tuple(words[i : i + n]) in windows for n in sizes for i in range(len(words) - n + 1))

    assert ids(after) == Counter(r.doc_id for r in before if not hit(r.text)) and len(after) < len(before)


def test_mixture_stage(chain):
    before, after = chain["source_mixture"]
    size = {r.doc_id: len(SPACED.findall(r.text or "")) for r in before}
    totals = Counter()
    for r in before:
        totals[r.source] += size[r.doc_id]
    names = sorted(totals, key=lambda s: (s is None, s or ""))
    taken = Counter()
    for r in after:
        taken[r.source] += size[r.doc_id]
    for name, target in zip(names, mixture.targets([totals[s] for s in names]), strict=True):
        longest = max(size[r.doc_id] for r in before if r.source == name)
        assert abs(taken[name] - target) <= longest
    assert set(ids(after)) <= set(ids(before)) and max(ids(after).values()) <= 2
    assert len({(r.doc_id, r.mix_copy) for r in after}) == len(after)


def test_whole_equals_chain(spark, sf_dir, chain):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    key = lambda r: (r.doc_id, r.mix_copy, r.mix_shard, r.mix_place)
    assert sorted(map(key, rows)) == sorted(map(key, chain["source_mixture"][1]))
