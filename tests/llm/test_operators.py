"""Training-data operators: edge cases and brute force on small tables."""

import hashlib
import time
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fieldloom.llm import bloom, components, decontaminate, exact_dedup, language_id, licences, line_dedup, mixture, queries, repeats, simhash, url_filter, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, digest int"
LONG = "this line is certainly longer than forty characters, and it repeats"
EDGES = [(1, None, None, None, None, "x", 1), (2, "", "en", "a", 0, "x", 1), (3, "Same Text here", "en", "a", 5, None, None), (4, "same text HERE", "en", "b", 5, "x", 2), (4, "same text HERE", "en", "b", 5, "x", 2), (None, "same text here", None, "b", 5, "x", 2), (None, "no id at all", "en", None, 5, "x", 2), (7, "ÉÈ été\n" + LONG, "fr", "a", 5, "x", 3), (8, "word " * 30000, "en", "a", 5, "x", 3)]
DOCUMENT_OPERATORS = {
    "language": lambda d: language_id.identify(d), "exact": exact_dedup.exact_dedup, "lines": line_dedup.line_dedup, "simhash": simhash.near_duplicates, "repeats": repeats.remove_repeats,
    "licences": licences.scan, "mixture": mixture.mix,
}


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, SCHEMA).cache()


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.mark.parametrize("name", DOCUMENT_OPERATORS)
def test_edge_cases_give_a_row_each(spark, edges, name):
    out = DOCUMENT_OPERATORS[name](edges)
    assert out.count() == len(EDGES)
    assert DOCUMENT_OPERATORS[name](edges.limit(0)).count() == 0


def test_exact_edges(edges):
    rows = exact_dedup.exact_dedup(edges).collect()
    same = [r for r in rows if r.group_size == 4]
    assert len(same) == 4 and {r.keep_id for r in same} == {4} and sum(r.kept for r in same) == 1
    assert {r.keep_id for r in rows if r.doc_id in (1, 2)} == {2}
    kept = exact_dedup.drop_repeats(edges)
    assert kept.columns == edges.columns and kept.count() == sum(r.kept for r in rows)


def test_exact_ids_at_the_ends_of_the_range(spark):
    low = -(2**63)
    rows = exact_dedup.exact_dedup(spark.createDataFrame([(low, "a"), (None, "a"), (low, "b"), (2**63 - 1, "B"), (None, "c"), (None, "C")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in rows) == [(False, low, low, 2, True), (False, low, 2**63 - 1, 2, False), (False, 2**63 - 1, 2**63 - 1, 2, True), (True, 0, low, 2, False), (True, 0, 0, 2, False), (True, 0, 0, 2, True)]


def test_minimal_perfect_hash_is_minimal_and_perfect():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64))
    levels, slots = exact_dedup.build_hash(keys)
    assert sorted(slots) == list(range(len(keys)))
    found, used = exact_dedup.find_slots(keys, levels)
    assert (found[found >= 0] == slots[found >= 0]).all() and used == (found >= 0).sum()
    _, clash = exact_dedup.build_hash(np.array([5, 5, 9], np.uint64))
    assert sorted(clash) == [0, 1, 2]


def test_language_held_out_accuracy(docs):
    rows = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.95 and all(0 <= r.score <= 1 for r in rows)


def test_language_undetermined(spark, docs):
    extra = spark.createDataFrame([(-1, "12 345 ###", "en"), (-2, None, "en")], "doc_id long, text string, lang string")
    rows = language_id.identify(docs.select("doc_id", "text", "lang").unionByName(extra)).where("doc_id < 0").collect()
    assert {(r.lang_pred, r.score) for r in rows} == {("und", 0.0)}
    kept = language_id.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() >= 0.98 * docs.count()


def test_line_dedup_keeps_the_largest_id(spark):
    rows = [(i, f"own line {i}\n  {LONG.upper() if i % 2 else LONG} \nshort") for i in range(6)] + [(10, "other " + LONG), (None, LONG)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.line_dedup(df).collect()}
    assert [out[i][:2] for i in range(6)] == [(3, 1)] * 5 + [(3, 0)] and out[10][:2] == (1, 0) and out[None][:2] == (1, 1)
    assert out[0][2] == hashlib.sha256(b"own line 0\nshort").hexdigest()
    texts = {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(df).collect()}
    assert texts[1] == "own line 1\nshort" and texts[10] == "other " + LONG


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_equals_brute_force(docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in fps:
        for j in fps:
            if i < j and (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    rows = simhash.near_duplicates(docs).collect()
    assert {(r.doc_id, int(r.fingerprint, 16), r.component_id) for r in rows} == {(i, fps[i], find(i)) for i in fps}
    kept = {r.doc_id for r in simhash.keep_one(docs, shingle=4).collect()}
    assert kept == {find(i) for i in fps}


@pytest.mark.parametrize(("shard", "levels"), [(256, 5), (3, 5), (1, 2)])
def test_simhash_links_large_shards(spark, monkeypatch, shard, levels):
    """All fingerprints by one search, by shards of shards, and by the last level's large shards."""
    monkeypatch.setattr(simhash, "SHARD", shard)
    monkeypatch.setattr(simhash, "LEVELS", levels)
    near = [0xABCDEF0123456789 ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(i)] + [1 << i for i in range(20, 26)] + [0x5555555555555555]
    signed = [x - (1 << 64) if x >> 63 else x for x in near]
    df = spark.createDataFrame([(x,) for x in signed], "fp long").distinct()
    roots = {r.node: r.root for r in components.components(simhash.links(df, 4)).collect()}
    groups = Counter(roots.get(x, x) for x in signed)
    assert sorted(groups.values()) == [1, 6, 66]


@pytest.mark.parametrize("together", [1 << 18, 50])
def test_components_of_a_long_chain_and_a_hub(spark, monkeypatch, together):
    """By one task at last, and by rounds of steps of several tasks."""
    monkeypatch.setattr(components, "TOGETHER", together)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, i) for i in range(1001, 1400)] + [(5000, 5001), (5001, 5000), (7, 7)]
    rows = components.components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()
    assert {r.node: r.root for r in rows} == {i: 0 for i in range(1, 301)} | {i: 1000 for i in range(1001, 1400)} | {5001: 5000} and len(rows) == 700
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pigeonhole_masks_leave_few_bits_free():
    assert [len(simhash._masks(level, 4)) for level in range(4)] == [1, 5, 25, 125]
    assert min(m.bit_count() for m in simhash._masks(1, 4)) == 12
    assert all(64 - m.bit_count() <= 23 for m in simhash._masks(5, 4))


def test_bloom_suspects_hold_every_repeat(spark, monkeypatch):
    """Many more keys than a segment holds: all that occur twice are suspects, and few others."""
    monkeypatch.setattr(bloom, "SEGMENT_KEYS", 64)
    monkeypatch.setattr(bloom, "CHUNK", 50)
    kind = np.dtype([("hash", np.uint64), ("place", np.int64)])
    rng = np.random.default_rng(2)
    values = rng.integers(0, 1 << 63, 6000).astype(np.uint64)
    hashes = np.concatenate([values, values[:500], np.repeat(values[500:501], 3000)])
    rng.shuffle(hashes)
    table = spark.createDataFrame([(int(h),) for h in hashes], "h long").repartition(5)

    def records(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 37):
                h = batch.column(0)[at : at + 37].to_numpy().astype(np.uint64)
                out = np.zeros(len(h), kind)
                out["hash"] = h
                yield out

    columns = lambda r: bloom.pa.RecordBatch.from_arrays([bloom.pa.array(r["hash"].astype(np.int64))], names=["h"])
    segments = bloom.segments_of(len(hashes))
    dealt = table.mapInArrow(lambda batches: bloom.dealt(records(batches), segments), bloom.DEALT)
    assert dealt.select("segment").distinct().count() > 100
    got, all_of = Counter(r.h for r in bloom.suspects(dealt, kind, columns, "h long").collect()), Counter(map(int, hashes))
    assert all(got[h] == n for h, n in all_of.items() if n > 1)
    assert sum(n for h, n in got.items() if all_of[h] == 1) < 60


def test_symbols_are_compared_byte_by_byte():
    text = np.frombuffer(bytes(range(200)) * 2, np.uint8)
    places = np.arange(0, 300, 10)
    forged = np.zeros(len(places), np.uint64)  # every hash collides
    symbols = repeats.symbols_of(text, places, forged)
    parts = [text[p : p + repeats.STEP].tobytes() for p in places]
    assert len(set(symbols)) == len(set(parts)) and len(set(zip(symbols, parts))) == len(set(parts))


@pytest.mark.parametrize("hot", [1000, 1, 0])
def test_repeats_equal_brute_force(docs, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    texts = {r.doc_id: (r.text or "").encode() for r in docs.limit(80).collect()}
    counts = Counter(t[i : i + 200] for t in texts.values() for i in range(len(t) - 199))
    want = {}
    for doc_id, t in texts.items():
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if counts[t[i : i + 200]] > 1:
                gone[i : i + 200] = True
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        want[doc_id] = (len(t), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest())
    some = docs.where(F.col("doc_id").isin(*texts))
    assert {r.doc_id: tuple(r)[1:] for r in repeats.remove_repeats(some).collect()} == want


def test_decontamination_in_rounds(spark, docs, sf_dir, monkeypatch):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    want = sorted(decontaminate.decontaminate(docs, bench).collect())
    monkeypatch.setattr(decontaminate, "ROUND_GRAMS", 100)
    monkeypatch.setattr(decontaminate, "ROUND_WINDOWS", 100)
    assert sorted(decontaminate.decontaminate(docs, bench).collect()) == want and any(r.contaminated for r in want)


def test_decontamination_edges(spark, edges):
    bench = spark.createDataFrame([(5, "SAME text"), (5, "same text"), (11, "word " * 12), (9, "!!"), (12, None)], "item_id long, text string")
    out = {(r.doc_id, r.n_words): (r.n_hit, r.n_items, r.contaminated) for r in decontaminate.decontaminate(edges, bench).collect()}
    assert out[3, 3] == (2, 1, True) and out[8, 30000] == (30000, 1, True) and out[1, 0] == (0, 0, False) and out[None, 4] == (0, 0, False)
    kept = decontaminate.drop_contaminated(edges, bench)
    assert kept.columns == edges.columns and kept.count() == 4
    left = {r.doc_id: r.kept_words for r in decontaminate.cut_contaminated(edges, bench).collect()}
    assert left[3] == ["here"] and left[8] == [] and left[1] == []
    assert decontaminate.decontaminate(edges, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.decontaminate(edges.limit(0), bench).count() == 0


def test_url_filter_cases(spark):
    urls = ["http://A.Example.org/es/1", "https://example.org/en/1?x", "https://example.org/en/2", "http://x.org", "http://org/", "http://xorg/", "http://evil.net/a.org/", "ftp://b.com/de/", "http://b.com/fr/#t", None, "no scheme", "http://h\n.org/p", "http://" + "y" * 5000 + ".org/"]
    rows = url_filter.url_filter(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()
    got = [(r.rule, r.verdict) for r in sorted(rows, key=lambda r: r.page_id)]
    assert got == [("example.org/es/", "block"), ("example.org/en/1", "block"), ("org/", "allow"), (None, "allow"), ("org/", "allow"), (None, "allow"), (None, "allow"), ("com/de/", "block"), ("com/fr/", "allow"), (None, "allow"), (None, "allow"), ("org/", "allow"), ("org/", "allow")]


def test_url_globs_over_several_words(spark):
    """Wildcards in hosts and paths, with rules that need several mask words, against a regular expression for each."""
    import re

    rules = [url_filter.Rule("ads*.example.com", "/", "block"), url_filter.Rule("shop.net", "/*/print", "block"), url_filter.Rule("?og.org", "/a?c", "block"), url_filter.Rule("a" * 150 + ".com", "/x", "block"), url_filter.Rule("*tracker*", "/", "block")]
    urls = ["http://ads.example.com/", "http://www.ads12.example.com/x", "http://bads.example.com/", "http://ads.evil.com/.example.com/", "http://shop.net/a/b/print?x", "http://shop.net/print", "http://dog.org/abcd", "http://og.org/abc", "http://x.dog.org/a/c", f"http://{'a' * 150}.com/x/y", f"http://{'a' * 149}.com/x", "http://my.tracker.io/", "http://my-tracker/", "http://x.io/tracker"]
    to_regex = lambda t, any_: "".join(any_ + "*" if ch == "*" else any_ if ch == "?" else re.escape(ch) for ch in t)
    want = []
    for url in urls:
        host, _, path = url.split("://", 1)[1].partition("/")
        path = ("/" + path).split("?")[0]
        fits = [r for r in rules if re.fullmatch("(.*\\.)?" + to_regex(r.host, "[^/]"), host) and re.match(to_regex(r.path, "."), path)]
        want.append(max(fits, key=lambda r: len(r.name)).name if fits else None)
    assert url_filter.Automaton(rules).words > 3
    rows = url_filter.url_filter(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()
    assert [r.rule for r in sorted(rows, key=lambda r: r.page_id)] == want and sum(x is not None for x in want) > 5
    assert url_filter.url_filter(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_language_score_by_brute_force(docs):
    """Words by log frequency, unseen ones by their longest known n-grams, without caches or matrices."""
    model = language_id.fit(docs.limit(60).where("doc_id % 2 = 0"), top_words=200, top_grams=300)
    for text in [r.text for r in docs.limit(100).collect() if r.text][:25] + ["zzq unseenword é", "x" * 3000 + " and"]:
        found = language_id.WORD.findall(text.lower())
        total = np.zeros(len(model.langs))
        for w in found:
            if w in model.tables[0]:
                total += model.weights[0][model.tables[0][w]]
                continue
            for size in range(language_id.LONGEST, 0, -1):
                padded = f"<{w}>"
                at = [model.tables[size][g] for i in range(len(padded) - size + 1) if (g := padded[i : i + size]) in model.tables[size]]
                if at:
                    total += sum(model.weights[size][i] for i in at) / len(at)
                    break
        scaled = total / len(found) * min(len(found), language_id.EVIDENCE)
        lang, score = model.predict(text)
        assert lang == model.langs[int(np.argmax(scaled))] and abs(score - 1 / np.exp(scaled - scaled.max()).sum()) < 1e-9


def test_language_of_one_endless_word(spark, docs):
    model = language_id.fit(docs)
    lang, score = model.predict("straße" * 300_000)
    assert lang in model.langs and 0 <= score <= 1
    assert model.predict("9" * 100_000 + "_") == ("und", 0.0)


def test_warc_repeated_rows(spark):
    pages = spark.createDataFrame([(1, "u", "same"), (1, "u", "same"), (0, "v", "same")], "page_id long, url string, html string")
    assert sorted(warc.round_trip(pages).select("page_id", "record_type").collect()) == [(0, "revisit"), (1, "response"), (1, "response")]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(1, "u\r\nv", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "w", None), (4, "x", ""), (None, "y", "<p>é</p>"), (5, "z", "a\r\n\r\nb")], "page_id long, url string, html string")
    out = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()}
    assert out == {1: (9, "revisit", 2), 2: (9, "response", None), 3: (0, "revisit", 4), 4: (0, "response", None), None: (9, "revisit", 2), 5: (6, "response", None)}
    assert warc.round_trip(pages.limit(0)).count() == 0
    assert warc.runs([(0, 10), (10, 5), (200_000, 5)]) == [[0, 1], [2]]


def test_licences(spark):
    text = "intro words\nLicensed under the\nApache License, Version 2.0.\nmore\nReleased under the MIT License.\nReleased under no licence at all whatsoever"
    found = {r.licence: (r.dice, r.first_line, r.n_lines) for r in licences.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()}
    assert found["Apache-2.0"] == (1.0, 1, 2) and found["MIT"] == (1.0, 4, 1) and set(found) == {"Apache-2.0", "MIT"}


def test_licences_inside_lines():
    held = licences.Templates()
    found = lambda text: {name: tuple(x) for name, *x in held.scan(text)}
    assert found("This small tool is Released under the MIT License.") == {"MIT": (1.0, 0, 1)}
    filler = "other words of a paragraph that goes on and on " * 30
    for name, notice in licences.TEMPLATES.items():
        assert found(filler + notice + " " + filler)[name] == (1.0, 0, 1)
    half = len(licences.TEMPLATES["BSD"]) // 2
    assert found("\n\nsome words " + licences.TEMPLATES["BSD"][:half].rsplit(" ", 1)[0] + "\n" + licences.TEMPLATES["BSD"][:half].rsplit(" ", 1)[1] + licences.TEMPLATES["BSD"][half:] + " " + filler) == {"BSD": (1.0, 2, 2)}
    assert found("x Licensed under CC BY-SA 4.0. y") == {"CC-BY-SA-4.0": (1.0, 0, 1)}
    assert set(found("Licensed under CC BY-SA 4.0. In parts it is Licensed under CC BY 4.0 only")) == {"CC-BY-SA-4.0", "CC-BY-4.0"}
    assert found(filler) == {} and held.scan(None) == []


def test_licences_tell_versions_and_variants_apart():
    held = licences.Templates()
    found = lambda text: {name for name, *_ in held.scan("Some words come first. " + text + " And others follow it.")}
    assert found(licences.TEMPLATES["BSD-2-Clause text"]) == {"BSD-2-Clause text"}
    assert found(licences.TEMPLATES["BSD-3-Clause text"]) == {"BSD-3-Clause text"}
    assert found(licences.TEMPLATES["BSD"]) == {"BSD"}
    free = "This {} is free software; you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
    assert found(free.format("program", "", "2")) == {"GPL-2.0 header"} and found(free.format("program", "", "3")) == {"GPL-3.0 header"}
    assert found(free.format("library", "Lesser ", "2.1")) == {"LGPL-2.1 header"} and found(free.format("library", "Library ", "2")) == {"LGPL-2.0 header"}
    assert found(free.format("program", "Affero ", "3")) == {"AGPL-3.0 header"} and found(free.format("program", "", "7")) == set()
    for part in ("BY", "BY-NC", "BY-SA", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
        for version in ("2.0", "2.5", "3.0", "4.0"):
            assert found(f"Licensed under CC {part} {version}.") == {f"CC-{part}-{version}"}
    assert found("Licensed under CC BY 9.0.") == set() and found("Licensed under the Apache License 2.0") == {"Apache-2.0"} and found("Licensed under the Apache License, Version 1.1") == set()
    assert found("This work is licensed under the GNU General Public License, version 3+.") == {"GPL-3.0"}
    for name in ("Unlicense text", "BSL-1.0 text", "MIT text"):
        assert name in found(licences.TEMPLATES[name])


def test_licences_scan_a_long_repeated_bigram_in_steps():
    held, start = licences.Templates(), time.monotonic()
    assert held.scan("the software " * 100_000) == [] and time.monotonic() - start < 30


def test_licences_equal_all_windows():
    """Every word window of a text against each template, brute force."""
    held, rng = licences.Templates(), np.random.default_rng(3)
    pool = [w for t in licences.TEMPLATES.values() for w in licences.normal_words(t)][:60]
    notices = [licences.normal_words(licences.TEMPLATES[n]) for n in ("MIT", "CC-BY-SA-4.0", "Apache-2.0", "BSD", "GPL-3.0", "CC-BY-ND-3.0", "GPL-2.0", "LGPL-2.1")]
    for _ in range(40):
        words = [str(w) for w in rng.choice(pool, 25)]
        for k in rng.choice(len(notices), 2):
            notice = [w for w in notices[k] if rng.random() > 0.06]
            words[(at := int(rng.integers(len(words)))) : at] = notice
        grams, every, versions = list(zip(words, words[1:])), [], list(map(licences.version_of, words))
        for i in range(len(grams)):
            for j in range(i, len(grams)):
                part = Counter(grams[i : j + 1])
                for name, want in held.grams.items():
                    if grams[i] not in want or grams[j] not in want or (name in held.version and held.version[name] not in versions[i : j + 3]):
                        continue
                    if (dice := 2 * (part & want).total() / (held.sizes[name] + j - i + 1)) >= held.min_dice:
                        every.append((name, dice, i, j))
        top = {name: max(d for n, d, *_ in every if n == name) for name, *_ in every}
        covered = lambda name, d, i, j: any(o != name and (f > d or (name in licences.FAMILIES and held.sizes[o] > held.sizes[name])) and a <= i and b >= j for o, f, a, b in every)
        got = {name: dice for name, dice, *_ in held.scan(" ".join(words))}
        free = {n for n, d, i, j in every if d == top[n] and not covered(n, d, i, j)}
        assert set(got) <= set(top) and free <= set(got) and all(got[n] == top[n] for n in free)


def test_mixture(spark, sf_dir, docs):
    rows = queries.op9_mixture(spark, sf_dir).collect()
    assert all(r.taken <= 2 * r.size for r in rows) and rows and {(r.doc_id, r.taken) for r in rows} == {(r.doc_id, r.taken) for r in queries.op9_mixture(spark, sf_dir).collect()}
    assert abs(sum({r.source_size: r.target for r in rows}.values()) / (1.5 * sum(r.size for r in rows)) - 1) < 0.2
    drawn = mixture.draw(docs)
    assert drawn.count() == sum(r.copies for r in rows) and drawn.where("mix_shard < 0 or mix_shard >= 16").count() == 0
    parts = mixture.split_tree([100, 7, 0], 8, np.random.default_rng(0))
    assert parts.sum(axis=0).tolist() == [100, 7, 0] and max(parts.sum(axis=1)) - min(parts.sum(axis=1)) <= 2
    assert mixture.targets([10, 100, 0]) == [20.0, 145.0, 0.0]


def test_mixture_of_many_sources(spark, monkeypatch):
    """Sources in several groups of the tree: targets as by hand, quotas of shards exact, all copies dealt."""
    monkeypatch.setattr(mixture, "GROUP", 5)
    rows = [(i, "w " * (i % 7 + 1), None if i % 23 == 22 else f"s{i % 23:02}") for i in range(3000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    planned = mixture.mix(table).collect()
    size = Counter()
    for _, text, source in rows:
        size[source] += len(text.split())
    names = sorted(size, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, mixture.targets([size[n] for n in names]), strict=True))
    source = {i: s for i, _, s in rows}
    assert all(abs(r.target - want[source[r.doc_id]]) < 1e-6 and r.source_size == size[source[r.doc_id]] for r in planned)
    assert all(len(r.shards) == r.copies and r.taken == r.size * r.copies for r in planned)
    taken = Counter()
    for r in planned:
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[n] - want[n]) <= 7 for n in names)
    quotas = spark.createDataFrame([(n, i, 10 * i + 1) for i, n in enumerate(names)], "source string, rank long, n long")
    ends = {r.e_source: r.ends for r in mixture.deal(quotas, 16, 7).collect()}
    assert all(ends[n][-1] == 10 * i + 1 for i, n in enumerate(names))
    loads = np.diff(np.array([[0, *ends[n]] for n in names]), axis=1).sum(axis=0)
    assert loads.sum() == sum(10 * i + 1 for i in range(len(names))) and loads.max() - loads.min() <= 4


def test_mixture_without_ids(spark):
    """Rows without an id are dealt by their texts."""
    table = spark.createDataFrame([(None, f"word{i} " * 3, f"s{i % 3}") for i in range(300)], "doc_id long, text string, source string")
    rows = mixture.mix(table).collect()
    sums = Counter()
    for r in rows:
        sums[r.target] += r.taken
    assert len(rows) == 300 and all(abs(n - t) <= 3 for t, n in sums.items())


def test_mixture_tree_deals_every_copy(spark):
    """All copies of a block, whole ones too, are within the tree's quotas, in mix() and draw()."""
    rows = [(i, "w", f"s{i % 20:02}") for i in range(1200)] + [(5000 + i, "w", "tiny") for i in range(40)]  # targets: 20 of 89 words, all 40 twice
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    block = F.pmod(F.xxhash64("doc_id", F.lit(mixture.SEED)), F.lit(mixture.BLOCKS)).alias("block")
    held = {r.doc_id: (r.source, r.block) for r in table.select("doc_id", "source", block).collect()}
    planned = mixture.mix(table, weights=(1,)).collect()
    assert all(len(r.shards) == r.copies for r in planned)
    assert all(r.copies == 2 for r in planned if r.doc_id >= 5000) and sum(r.copies for r in planned) == 20 * 89 + 80
    assert sorted((r.doc_id, i, s) for r in planned for i, s in enumerate(r.shards)) == sorted((r.doc_id, r.mix_copy, r.mix_shard) for r in mixture.draw(table, weights=(1,)).collect())
    units = {(*held[r.doc_id], i): s for r in planned for i, s in enumerate(r.shards)}
    assert all(units[(*held[r.doc_id], i)] == s for r in planned for i, s in enumerate(r.shards))
    names = sorted({s for s, _ in held.values()})
    got = Counter((shard, source) for (source, _, _), shard in units.items())
    parts = mixture.split_tree([sum(source == n for source, _, _ in units) for n in names], mixture.SHARDS, np.random.default_rng(mixture.SEED))
    assert [[got[k, n] for n in names] for k in range(mixture.SHARDS)] == parts.tolist()
    assert max(parts.sum(axis=1)) - min(parts.sum(axis=1)) <= 2
