"""Importance resampling against a plain computation in one process."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fieldloom.llm import importance

SCHEMA = "doc_id long, text string, row string, score long, place int"


def plain(docs, target, runs=(1, 1), buckets=10_000, percent=10, min_words=20, seed=2024):
    def words(text):
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered) if w]

    def features(w):
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(runs[0], runs[1] + 1) for i in range(len(w) - n + 1)]

    made = [(doc_id, words(text)) for doc_id, text in docs]
    s, t = Counter(b for _, w in made for b in features(w)), Counter(b for text in target for b in features(words(text)))
    s_all, t_all = sum(s.values()), sum(t.values())
    ratio = lambda b: (t[b] + 1.0) * (s_all + buckets) / ((s[b] + 1.0) * (t_all + buckets))
    rows = []
    for at, (doc_id, w) in enumerate(made):
        f = features(w)
        weight = sum(math.floor(1000 * math.log(ratio(b))) for b in f)
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w), at])
    order = sorted((r for r in rows if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for rank, r in enumerate(order[: percent * len(order) // 100], 1):
        r[4] = rank
    return rows


def sorted_rows(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, x or 0) for x in r))


def rows_of(spark, docs):
    return spark.createDataFrame([(d, t, "x", 1, 1) for d, t in docs], SCHEMA)


@pytest.mark.parametrize("runs,buckets,percent,bits", [((1, 1), 10_000, 10, 6), ((1, 2), 97, 35, 4), ((2, 3), 10_000, 100, 6)])
def test_equals_a_plain_computation(spark, sf_dir, monkeypatch, runs, buckets, percent, bits):
    monkeypatch.setattr(importance, "BITS", bits)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    docs += [(10**6 + i, docs[3][1]) for i in range(300)] + [(None, None), (None, ""), (5, "one two"), (None, docs[4][1])] + [docs[4]] * 40
    got = importance.resample(rows_of(spark, docs), spark.createDataFrame([(t,) for t in target], "text string"), percent=percent, runs=runs, buckets=buckets).collect()
    assert sorted_rows((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got) == sorted_rows(r[:5] for r in plain(docs, target, runs, buckets, percent))


def test_ties_and_repeated_rows(spark):
    text = "word " * 25
    docs = [(7, text)] * 50 + [(None, text)] * 3 + [(2**63 - 1, text), (-(2**63), text)]
    target = spark.createDataFrame([], "text string")
    for percent in (1, 50, 100):
        got = importance.resample(rows_of(spark, docs), target, percent=percent)
        want = plain(docs, [], percent=percent)
        assert sorted_rows((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got.collect()) == sorted_rows(r[:5] for r in want)


def test_cutoff_by_bisection(spark, monkeypatch):
    values = [5, 5, 5, -3, 40, 7, 7]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    wide = spark.createDataFrame([(-(2**63),), (2**63 - 1,), (3,), (3,)], "v long")
    assert [importance.cutoff(wide, F.col("v"), k) for k in (1, 3)] == [(2**63 - 1, 0), (3, 1)]
    for bits in (1, 2):
        monkeypatch.setattr(importance, "BITS", bits)
        for k in (1, 2, 4, 7):
            want = sorted(values, reverse=True)[k - 1]
            assert importance.cutoff(df, F.col("v"), k) == (want, sum(v > want for v in values))


def test_little_to_draw_from(spark):
    target = spark.createDataFrame([("a b",), (None,)], "text string")
    few = rows_of(spark, [(i, "w " * 30) for i in range(9)])
    assert [r["rank"] for r in importance.resample(few, target).collect()] == [None] * 9
    assert importance.resample(few.limit(0), target).count() == 0
    drawn = importance.draw(few, target, percent=50)
    assert drawn.columns == [*few.columns, "importance_rank"] and sorted(r.importance_rank for r in drawn.collect()) == [1, 2, 3, 4]
    assert {r.text for r in drawn.collect()} == {"w " * 30}
