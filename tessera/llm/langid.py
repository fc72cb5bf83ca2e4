"""Language identification, words first: a known word counts by its log frequency in each language;
an unknown one backs off to its longest known character n-grams, from five characters down to one.

The model is fitted on a bounded sample (``PER_LANGUAGE`` documents of each language, the first by a
hash of their ids) and keeps the ``KEEP_WORDS`` and ``KEEP_GRAMS`` most frequent words and n-grams of
each language, fewer of each if there are so many languages that the table would pass ``MOST_WEIGHTS``
numbers; that makes it safe to send to every worker, and leaves a rare language as large a share as
a frequent one. No language is left out: more than ``MOST_LANGUAGES`` are refused. Prediction reads every
whole text, some words at a time.

Defined cases: a null text or one without letters is ``und`` with score 0; documents with a null
lang or id, or in the held-out fold, teach nothing; equal scores go to the language that sorts first;
with nothing learned all is ``und``; repeated rows are predicted alike; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.text import chunks, held_out, walk
from tessera.session import materialise

LONGEST = 5
PER_LANGUAGE = 3000
MOST_LANGUAGES = 400
HASH_RANGE = 1 << 24
KEEP_WORDS, KEEP_GRAMS = 15_000, 30_000
MOST_WEIGHTS = 1 << 24
#: What each language may keep at least, of words and of n-grams.
LEAST_SHARE = 100
#: Words of a text that are scored at a time.
STRIP = 1 << 16
UNKNOWN = "und"
_LETTERS = regex.compile(r"[\p{L}\p{M}]*\p{L}[\p{L}\p{M}]*")
_ASCII = str.maketrans({c: " " for c in map(chr, range(128)) if not c.isalpha()})


def words_of(text: str) -> list[str]:
    text = text.lower()
    if text.isascii():
        return text.translate(_ASCII).split()
    return _LETTERS.findall(text)


def grams_of(word: str, n: int) -> list[str]:
    padded = f"_{word}_"
    if len(padded) < n:
        return []
    return [padded[k : k + n] for k in range(len(padded) - n + 1)] if n > 1 else list(word)


@dataclass
class Model:
    """Rows of ``weights`` are log frequencies by language; words and n-grams point at their rows."""

    languages: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    weights: np.ndarray

    def back_off(self, word: str) -> tuple[int, ...]:
        """Rows of the longest known n-grams of an unknown word."""
        get, padded = self.grams.get, f"_{word}_"
        for n in range(LONGEST, 0, -1):
            text = padded if n > 1 else word
            found = [i for k in range(len(text) - n + 1) if (i := get(text[k : k + n])) is not None]
            if found:
                return tuple(found)
        return ()


def _total(model: Model, words: list[str], cache: dict[str, tuple[int, ...]]) -> np.ndarray:
    """The words' log frequencies in each language, added up."""
    rows = [model.words.get(w, -1) for w in words]
    known = [i for i in rows if i >= 0]
    total = model.weights[known].sum(axis=0, dtype=np.float64)
    if len(known) < len(rows):
        parts = []
        for w, i in zip(words, rows, strict=True):
            if i < 0:
                found = cache.get(w)
                if found is None:
                    found = cache[w] = model.back_off(w)
                if found:
                    parts.append(found)
        if parts:
            share = np.repeat([1.0 / len(p) for p in parts], [len(p) for p in parts])
            total = total + share @ model.weights[[i for p in parts for i in p]]
    return total


def predict_text(model: Model, text: str | None, cache: dict[str, tuple[int, ...]]) -> tuple[str, float]:
    words = words_of(text) if text else []
    if not words or not model.languages:
        return UNKNOWN, 0.0
    total = sum(_total(model, words[k : k + STRIP], cache) for k in range(0, len(words), STRIP))
    tempered = total / len(words) ** 0.5
    p = np.exp(tempered - tempered.max())
    best = int(p.argmax())
    return model.languages[best], float(min(1.0, p[best] / p.sum()))


def _count(docs: DataFrame) -> DataFrame:
    """(lang, kind, gram, n) summed per batch in the workers; kind is 0 for words, else the length."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            counts: dict[tuple[str, int], Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts.setdefault((lang, 0), Counter()).update(words_of(text or ""))
            for (lang, _), words in list(counts.items()):
                for n in range(1, LONGEST + 1):
                    c = counts[lang, n] = Counter()
                    for w, k in words.items():
                        for g in grams_of(w, n):
                            c[g] += k
            rows = [(lang, kind, g, k) for (lang, kind), c in counts.items() for g, k in c.items()]
            if rows:
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.int64()), strict=True)], names=["lang", "kind", "gram", "n"])

    return walk(docs.select("lang", "text"), run, "lang string, kind int, gram string, n long")


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, keep_words: int = KEEP_WORDS, keep_grams: int = KEEP_GRAMS) -> Model:
    ids = docs.select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang")).filter("_id is not null and _lang is not null").filter(~held_out(F.col("_id")))
    # a share of each language's ids, by their hash, that leaves about twice the wanted number for the ranking
    found = ids.groupBy("_lang").agg(F.count(F.lit(1)).alias("n")).orderBy("_lang").limit(MOST_LANGUAGES + 1).collect()
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    share = F.create_map(*[F.lit(x) for r in found for x in (r["_lang"], min(HASH_RANGE, -(-2 * per_language * HASH_RANGE // r["n"])))]) if found else F.create_map().cast("map<string,int>")
    ids = ids.filter(F.pmod(F.xxhash64("_id", F.lit(3)), F.lit(HASH_RANGE)) < F.try_element_at(share, F.col("_lang")))
    order = Window.partitionBy("_lang").orderBy(F.xxhash64("_id"), "_id")
    # at most per_language ids for each language, hence the broadcast
    chosen = ids.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= per_language).select("_id", "_lang").distinct()
    sample = docs.select("doc_id", "lang", "text").join(F.broadcast(chosen), (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_lang")), "left_semi")
    counts = _count(sample).groupBy("kind", "gram", "lang").agg(F.sum("n").alias("n"))
    by = F.collect_list(F.struct("lang", "n"))
    grouped = materialise(counts.groupBy("kind", "gram").agg(F.sum("n").alias("total"), by.alias("by")), "gram-counts")
    sums = {(r["kind"], r["lang"]): r["n"] for r in grouped.select("kind", F.explode("by").alias("x")).groupBy("kind", "x.lang").agg(F.sum("x.n").alias("n")).collect()}
    languages = sorted({lang for _, lang in sums})
    each = MOST_WEIGHTS // (3 * max(1, len(languages)) ** 2)
    shares = (max(LEAST_SHARE, min(keep_words, each)), max(LEAST_SHARE, min(keep_grams, 2 * each)))
    first = Window.partitionBy(F.col("kind") == 0, "lang").orderBy(F.desc("n"), "kind", "gram")
    ranked = grouped.select("kind", "gram", F.explode("by").alias("x")).select("kind", "gram", "x.*").withColumn("k", F.row_number().over(first))
    wanted = ranked.filter(F.col("k") <= F.when(F.col("kind") == 0, shares[0]).otherwise(shares[1])).select("kind", "gram").distinct()
    # at most both shares for each language, as fetched here
    top = grouped.join(wanted, ["kind", "gram"], "left_semi").select("kind", "gram", "by").toArrow()
    kinds, names, by = top.column("kind").to_numpy(), top.column("gram").to_pylist(), top.column("by").combine_chunks()
    # half a count for each word or n-gram there is, so that one unseen in a rare language isn't likely in it
    kinds_of = {r["kind"]: r["count"] for r in grouped.groupBy("kind").count().collect()}
    all_ = np.array([[sums.get((kind, lang), 0) + 0.5 * kinds_of.get(kind, 0) for lang in languages] for kind in range(LONGEST + 1)]).reshape(LONGEST + 1, -1)
    n = np.zeros((len(names), len(languages)))
    entries = by.flatten()
    place = {lang: k for k, lang in enumerate(languages)}
    n[np.repeat(np.arange(len(names)), by.value_lengths().to_numpy()), [place[x] for x in entries.field("lang").to_pylist()]] = entries.field("n").to_numpy()
    v = np.log((n + 0.5) / all_[kinds])
    v = (v - v.mean(axis=1, keepdims=True) if len(v) else v).astype(np.float32)
    pointers = [{names[k]: int(k) for k in np.flatnonzero((kinds > 0) == longer)} for longer in (False, True)]
    return Model(languages, *pointers, v)


def predict(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, cache = shared.value, {}
        for batch in chunks(batches, "text"):
            if len(cache) > 80_000:
                cache.clear()
            found = [predict_text(m, t, cache) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return walk(rows, run, "doc_id long, held_out boolean, lang_pred string, score double")
