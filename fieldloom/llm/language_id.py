"""Language identification: known words by log frequency, unseen words by ever shorter character n-grams.

The model is fitted on a bounded, documented sample: at most fit_rows labelled documents of each language, picked by a
hash of doc_id. It keeps at most top_words words and top_grams n-grams of each length a language (and at most MODEL_ROWS
in all), so its broadcast has a fixed bound. Prediction reads every whole text and nothing but the text.

Defined cases: null text or a text without a letter is `und` with score 0; so is every text when there is no labelled
row. Ties go to the language that sorts first. Very long texts are read in slices that do not cut words, and very long
words by blocks of n-grams. Repeated rows are judged each; a null doc_id is not held out. Other columns may have any names;
empty tables give none.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import per_row, written

WORD = re.compile(r"[^\W\d_]+")
LONGEST = 5
SLICE = 1 << 20
MODEL_ROWS = 1_000_000
#: Evidence counts as that of this many words at most, so that score tells sure from unsure texts.
EVIDENCE = 20
CACHE = 200_000
#: Words of more letters are not kept in the cache; n-grams are listed by blocks of so many.
LONG, LISTED = 1000, 1 << 16


def words(text: str) -> Iterator[list[str]]:
    """The lower-cased words of a text, in lists of bounded length."""
    text, at = text.lower(), 0
    while at < len(text):
        end = min(len(text), at + SLICE)
        while end < len(text) and text[end].isalpha():
            end += 1
        yield WORD.findall(text, at, end)
        at = end


def grams(word: str, n: int) -> Iterator[list[str]]:
    """The n-grams of a word with marks at its ends, in lists of bounded length."""
    padded = f"<{word}>"
    for at in range(0, len(padded) - n + 1, LISTED):
        yield [padded[i : i + n] for i in range(at, min(at + LISTED, len(padded) - n + 1))]


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def out() -> pa.RecordBatch:
        rows = list(counts.items())
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], names=["lang", "word", "n"])

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for some in words(text):
                for word, n in Counter(some).items():
                    counts[lang, word] += n
            if len(counts) > 200_000:
                yield out()
    yield out()


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def out() -> pa.RecordBatch:
        columns = list(zip(*[(*k, n) for k, n in counts.items()], strict=True)) or [()] * 4
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.int64()), strict=True)], names=["lang", "size", "gram", "n"])

    for batch in batches:
        for lang, word, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            for size in range(1, LONGEST + 1):
                for some in grams(word, size):
                    for gram in some:
                        counts[lang, size, gram] += n
                    if len(counts) > 200_000:
                        yield out()
    yield out()


class Model:
    """Log frequencies: for size 0 of words, for 1 to LONGEST of n-grams."""

    def __init__(self, langs: list[str], tables: list[dict[str, int]], weights: list[np.ndarray]):
        self.langs, self.tables, self.weights = langs, tables, weights
        self.forget()

    def forget(self) -> None:
        """One table of the words that the model knows, with room for unseen ones."""
        self.at = dict(self.tables[0])
        self.rows = np.vstack([self.weights[0], np.zeros((CACHE, len(self.langs)))])

    def __reduce__(self):
        return Model, (self.langs, self.tables, self.weights)

    @classmethod
    def of(cls, rows: list[tuple[str, int, str, int]], totals: dict[tuple[str, int], int]) -> Model:
        langs = sorted({lang for lang, _ in totals})
        at = {lang: i for i, lang in enumerate(langs)}
        tables: list[dict[str, int]] = [{} for _ in range(LONGEST + 1)]
        for _, size, gram, _ in rows:
            tables[size].setdefault(gram, len(tables[size]))
        weights = []
        for size, table in enumerate(tables):
            counts = np.zeros((len(table), len(langs)))
            for lang, s, gram, n in rows:
                if s == size:
                    counts[table[gram], at[lang]] = n
            total = np.array([totals.get((lang, size), 0) for lang in langs])
            weights.append(np.log((counts + 0.5) / (total + 0.5 * len(table) + 1)))
        return cls(langs, tables, weights)

    def by_grams(self, word: str) -> np.ndarray:
        """The weights of an unseen word: of the longest n-grams of which the model knows any, the mean."""
        for size in range(LONGEST, 0, -1):
            get, total, n = self.tables[size].get, np.zeros(len(self.langs)), 0
            for some in grams(word, size):
                if at := [i for g in some if (i := get(g)) is not None]:
                    total += self.weights[size].take(at, axis=0).sum(axis=0)
                    n += len(at)
            if n:
                return total / n
        return np.zeros(len(self.langs))

    def unseen(self, word: str) -> int:
        """The row that keeps the weights of an unseen word."""
        row = self.at[word] = len(self.at)
        self.rows[row] = self.by_grams(word)
        return row

    def predict(self, text: str | None) -> tuple[str, float]:
        total, n, letter = np.zeros(len(self.langs)), 0, False
        for some in words(text or ""):
            if len(self.at) + len(some) > len(self.rows):
                self.forget()
            if len(some) > CACHE:
                self.rows = np.vstack([self.rows, np.zeros((len(some), len(self.langs)))])
            counts = Counter(some)
            for word in [w for w in counts if len(w) > LONG and w not in self.at]:
                letter = letter or any(map(str.isalpha, word))
                total += counts.pop(word) * self.by_grams(word)
            letter = letter or any(any(map(str.isalpha, w)) for w in counts)
            at = list(map(self.at.get, counts))
            if None in at:
                at = [self.unseen(w) if i is None else i for w, i in zip(counts, at, strict=True)]
            n += len(some)
            if counts:
                total += np.array(list(counts.values())) @ self.rows[at]
        if not letter or not self.langs:
            return "und", 0.0
        scaled = total / n * min(n, EVIDENCE)
        best = int(np.argmax(scaled))
        return self.langs[best], float(1 / np.exp(np.minimum(scaled - scaled[best], 0)).sum())


def fit(docs: DataFrame, fit_rows: int = 4_000, top_words: int = 10_000, top_grams: int = 5_000) -> Model:
    """Fits on labelled rows (lang, text, doc_id); at most about fit_rows of each language, chosen by a hash of doc_id."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = dict(labelled.groupBy("lang").count().collect())
    if not counts:
        return Model([], [{} for _ in range(LONGEST + 1)], [np.zeros((0, 0))] * (LONGEST + 1))
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, fit_rows / n)))])
    sample = labelled.where(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)
    seen = sample.select("lang", "text").mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    seen = written(seen, "language-words")
    pieces = seen.mapInArrow(_count_grams, "lang string, size int, gram string, n long").groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))
    pieces = written(seen.select("lang", F.lit(0).alias("size"), F.col("word").alias("gram"), "n").unionByName(pieces), "language-grams")
    room = max(1, MODEL_ROWS // (len(counts) * (LONGEST + 1)))
    rank = F.row_number().over(Window.partitionBy("lang", "size").orderBy(F.desc("n"), "gram"))
    top = pieces.withColumn("rank", rank).where(F.col("rank") <= min(room, max(top_words, top_grams)))
    top = top.where((F.col("size") == 0) & (F.col("rank") <= min(room, top_words)) | (F.col("rank") <= min(room, top_grams)))
    totals = {(lang, size): n for lang, size, n in pieces.groupBy("lang", "size").agg(F.sum("n")).collect()}
    totals |= {(lang, 0): totals.get((lang, 0), 0) for lang in counts}
    return Model.of([tuple(r) for r in top.select("lang", "size", "gram", "n").orderBy("lang", "size", F.desc("n"), "gram").collect()], totals)


def predict(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs without that text column, with the predicted language and its score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: list) -> list[list]:
        made = [sent.value.predict(t) for t in texts]
        return [[x for x, _ in made], [x for _, x in made]]

    return per_row(docs, text, run, {lang: pa.string(), score: pa.float64()}, f"{lang} string, {score} double", binary=False)


def identify(docs: DataFrame, **limits: int) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score. Learns from the rows that are not held out."""
    rows = docs.select("doc_id", "lang", "text", held_out(F.col("doc_id")).alias("held_out"))
    model = fit(rows.where(~F.col("held_out")), **limits)
    return predict(rows.select("doc_id", "held_out", "text"), model)


def keep_identified(docs: DataFrame, min_score: float = 0.4, **limits: int) -> DataFrame:
    """docs without those that have no language: `und`, or a score below min_score; columns stay as they are."""
    model = fit(docs.select("doc_id", "lang", "text").where(~held_out(F.col("doc_id"))), **limits)
    judged = predict(docs.select(F.struct("*").alias("row"), F.col("text").alias("text")), model)
    return judged.where((F.col("lang_pred") != "und") & (F.col("score") >= min_score)).select("row.*")
