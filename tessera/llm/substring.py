"""Substring dedup by recompression: long repeats found through consistent names of token runs and pairs.

Words are ``[^\\x20\\x09-\\x0D]+``. Rounds rename a document's symbols, at first its words: a run of
one symbol becomes a symbol, then each pair whose first symbol falls, by a bit of its name, in the
left half of the alphabet and whose second in the right half. A name is a 64-bit hash of what it
stands for, and so is the same on every executor without a dictionary. Whether neighbours merge
depends on them alone, and symbols are kept to a bounded number of words (``ROUNDS``); hence in
equal stretches of words all symbols are equal but for ``MARGIN`` words at either end.

1. In each window of 50 words the least named of the symbols that start in its middle is its anchor.
   Windows that follow each other with one anchor are a stretch. All of them hold the words from
   MARGIN before the anchor on; these, the core, get a name of a higher level, and so does the whole
   stretch.
2. A core name in two documents reveals a repeat. Of stretches with equal names only the one in the
   smallest document can be new: the others are repeats throughout.
3. Where a core stands in stretches of several names, one stretch of each name is taken apart, and its
   windows are verified one by one by their own names.

What decides is always a core's name together with a stretch's or window's own: 128 bits, by two
families of hashes, so that among 10**13 windows no two unlike ones are expected to meet.

Only names, ids and places are shuffled. A hot passage is one name with many places; names are
aggregated by minimum before the shuffle and joined back, never collected; where one core stands in
many stretches they are dealt by salt.

Defined cases: null texts have no words; texts under 50 words are never cut; rows with a null id
neither lose nor claim words; rows that share an id never cut each other, and places are told apart
by a hash of the text; an empty table gives no rows; long texts are read in pieces and have no limit;
other columns pass through ``drop_repeats``, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import U64, WordHashes, chunks, free_name, mix, walk, word_blocks
from tessera.session import materialise

WINDOW = 50
#: Most words in the symbol of a run and of a pair, in each round.
ROUNDS = ((2, 4), (4, 8))
#: What a round may leave undecided at an end: a run cut off there, and a symbol that may pair outwards.
MARGIN = sum(run + run for run, _ in ROUNDS)
LARGEST = ROUNDS[-1][1]
PLACES = WINDOW - 2 * MARGIN - LARGEST + 1
_BASE = U64(0x9E3779B97F4A7C15)
#: Cores are named by hashes of their own, so that a core's name and a stretch's make 128 bits.
_CORE_BASE, _CORE_SALT = U64(0xA0761D6478BD642F), U64(0xE7037ED1A0B428DB)
_SALT = mix(np.arange(1, 4 * len(ROUNDS) + 2, dtype=U64) * U64(0xC2B2AE3D27D4EB4F))
STRETCHES = "array<struct<start:int,n:int,core:bigint,body:bigint>>"
#: A core's places are dealt to so many tasks where a join would otherwise gather them in one.
SALTS = 16
#: How a span is packed into one number: start, number of windows (at most PLACES), where it is from.
_N, _KINDS = 64, 4


def _runs(names: np.ndarray, sizes: np.ndarray, most: int, salt: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Names maximal runs of one symbol that have at most ``most`` words."""
    if len(names) < 2 or not (names[1:] == names[:-1]).any():
        return names, sizes
    first = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
    count = np.diff(np.append(first, len(names)))
    words = np.add.reduceat(sizes, first)
    merged = (count > 1) & (words <= most)
    keep = ~np.repeat(merged, count)
    keep[first] = True
    names, out = names.copy(), sizes.copy()
    at = first[merged]
    names[at] = mix(names[at] * salt + count[merged].astype(U64))
    out[at] = words[merged]
    return names[keep], out[keep]


def _pairs(names: np.ndarray, sizes: np.ndarray, most: int, side: np.uint64, salt: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Names the pairs of a left and a right symbol. Separators have 2 * LARGEST words, too many to pair."""
    if len(names) < 2:
        return names, sizes
    right = (mix(names ^ side) & U64(1)).astype(bool)
    at = np.flatnonzero(~right[:-1] & right[1:] & (sizes[:-1] + sizes[1:] <= most))
    keep = np.ones(len(names), bool)
    keep[at + 1] = False
    names, out = names.copy(), sizes.copy()
    names[at] = mix(mix(names[at] * salt) + names[at + 1])
    out[at] += sizes[at + 1]
    return names[keep], out[keep]


def recompress(words: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbol names and the places where they start, over a row of texts; breaks mark separators."""
    names = words
    sizes = np.where(breaks, 2 * LARGEST, 1).astype(np.int64)
    for k, (run, pair) in enumerate(ROUNDS):
        names, sizes = _runs(names, sizes, run, _SALT[3 * k])
        names, sizes = _pairs(names, sizes, pair, _SALT[3 * k + 1], _SALT[3 * k + 2])
    sizes = np.where(sizes == 2 * LARGEST, 1, sizes)
    return names, np.cumsum(sizes) - sizes


def _first_least(keys: np.ndarray, width: int) -> np.ndarray:
    """For each place where the least of the ``width`` keys that start there stands; of equal ones the first."""
    at = np.arange(len(keys))

    def lesser(left: slice, right: slice) -> None:
        nonlocal keys, at
        take = keys[left] <= keys[right]
        keys, at = np.where(take, keys[left], keys[right]), np.where(take, at[left], at[right])

    reach = 1
    while reach * 2 <= width:
        lesser(slice(None, -reach), slice(reach, None))
        reach *= 2
    if rest := width - reach:
        lesser(slice(None, -rest), slice(rest, None))
    return at


class Names:
    """Names of any stretch of a row of words: polynomial hashes from prefix sums."""

    def __init__(self, words: np.ndarray, base: np.uint64 = _BASE) -> None:
        power = np.full(len(words) + 1, base, dtype=U64)
        power[0] = U64(1)
        back = np.full(len(words) + 1, U64(pow(int(base), -1, 1 << 64)), dtype=U64)
        back[0] = U64(1)
        self.back = np.cumprod(back, dtype=U64)
        self.sums = np.concatenate([np.zeros(1, U64), np.cumsum(words * np.cumprod(power, dtype=U64)[:-1], dtype=U64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(U64)).view(np.int64)


def stretches_of(texts: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each text (word hashes) its stretches: start, number of windows, core name, name."""
    sizes = np.array([len(t) for t in texts])
    starts = np.cumsum(sizes + 1) - sizes - 1
    total = int(sizes.sum()) + len(texts)
    words, breaks = np.zeros(total, U64), np.zeros(total, bool)
    for t, at in zip(texts, starts, strict=True):
        words[at : at + len(t)] = t
    ends = starts + sizes
    breaks[ends] = True
    words[ends] = mix(np.arange(len(texts), dtype=U64) + _SALT[-1])
    names, places = recompress(words, breaks)
    keys = np.full(total + WINDOW, ~U64(0), dtype=U64)
    keys[places] = mix(names)
    least = _first_least(keys[MARGIN:], PLACES)
    long = np.flatnonzero(sizes >= WINDOW)
    empty = np.zeros(0, np.int64)
    out = [(empty, empty, empty, empty)] * len(texts)
    if not len(long):
        return out
    windows = np.concatenate([np.arange(starts[d], ends[d] - WINDOW + 1) for d in long])
    anchors = least[windows] + MARGIN
    first = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]]))
    count = np.diff(np.append(first, len(windows)))
    at, anchor = windows[first], anchors[first]
    core = Names(mix(words ^ _CORE_SALT), _CORE_BASE).of(anchor - MARGIN, anchor - MARGIN - PLACES + 1 + WINDOW)
    body = Names(words).of(at, at + count - 1 + WINDOW)
    cut = np.searchsorted(at, starts[long])
    for d, a, b in zip(long, cut, np.append(cut[1:], len(at)), strict=True):
        out[d] = (at[a:b] - starts[d], count[a:b], core[a:b], body[a:b])
    return out


def window_names(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return Names(words).of(starts, starts + WINDOW)


def _whole(text: bytes | None) -> bytes:
    """Digest of all words, joined by one space."""
    out, before = hashlib.sha256(), b""
    for block in word_blocks(text) if text else ():
        if block:
            out.update(before + b" ".join(block))
            before = b" "
    return out.digest()


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, mark (hash of the text, which tells rows of one id apart), text."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))


def _parsed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, mark, n_words, whole (digest of all words), stretches of each row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        kind = pa.struct([("start", pa.int32()), ("n", pa.int32()), ("core", pa.int64()), ("body", pa.int64())])
        for batch in chunks(batches, "text"):
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            words = [hashes.of_text(t) for t in texts]
            found = stretches_of(words)
            offsets = np.concatenate([[0], np.cumsum([len(f[0]) for f in found])])
            fields = [pa.array(np.concatenate([f[k] for f in found]), t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([len(w) for w in words], pa.int64()),
                    pa.array([_whole(t) for t in texts], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(kind))),
                ],
                names=["doc_id", "mark", "n_words", "whole", "stretches"],
            )

    return walk(_rows(docs, id_col, text_col), run, f"doc_id long, mark long, n_words long, whole binary, stretches {STRETCHES}")


def _windows(rows: DataFrame) -> DataFrame:
    """(core, name, doc_id, mark, start) of each window of the stretches ``parts`` of a text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in chunks(batches, "text"):
            for doc_id, mark, text, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist(), strict=True):
                words = hashes.of_text(text)
                named, at = Names(words), sorted({(p["start"], p["n"], p["core"]) for p in parts})
                for k in range(0, len(at), 10_000):
                    starts = np.concatenate([np.arange(a, a + n) for a, n, _ in at[k : k + 10_000]])
                    cores = np.repeat(np.array([c for _, _, c in at[k : k + 10_000]], np.int64), [n for _, n, _ in at[k : k + 10_000]])
                    columns = [pa.array(cores), pa.array(named.of(starts, starts + WINDOW)), pa.array(np.full(len(starts), doc_id, np.int64)), pa.array(np.full(len(starts), mark, np.int64)), pa.array(starts, pa.int32())]
                    yield pa.RecordBatch.from_arrays(columns, names=["core", "name", "doc_id", "mark", "start"])

    return walk(rows.select("doc_id", "mark", "text", "parts"), run, "core long, name long, doc_id long, mark long, start int")


def _packed(kind: int) -> Column:
    """A span and where it is from as one number."""
    return (F.col("start").cast("long") * _N + F.col("n")) * _KINDS + kind


def removed_words(n_words: int, codes: np.ndarray) -> np.ndarray:
    """A mask of the words under the spans: live stretches (0) but for those that stay (1), and windows found (2)."""
    kind, span = codes % _KINDS, codes // _KINDS
    spans = np.concatenate([np.setdiff1d(span[kind == 0], span[kind == 1]), np.unique(span[kind == 2])])
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, spans // _N, 1)
    np.add.at(edge, spans // _N + spans % _N - 1 + WINDOW, -1)
    return np.cumsum(edge[:-1]) > 0


def _cut(rows: DataFrame, with_text: bool) -> DataFrame:
    """doc_id, mark, n_removed, kept (digest), and the kept text, of texts with spans."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            gone, digests, texts = [], [], []
            spans = batch.column(4)
            for k, (text, n_words) in enumerate(zip(batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                mask, at, kept = removed_words(n_words, spans[k].values.to_numpy()), 0, []
                for block in word_blocks(text):
                    here = mask[at : at + len(block)]
                    at += len(block)
                    left = block if not here.any() else [w for w, x in zip(block, here.tolist(), strict=True) if not x]
                    if left:
                        kept.append(b" ".join(left))
                rest = b" ".join(kept)
                gone.append(int(mask.sum()))
                digests.append(hashlib.sha256(rest).digest())
                texts.append(rest if with_text else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(gone, pa.int64()), pa.array(digests, pa.binary()), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "mark", "n_removed", "kept", "kept_text"]
            )

    return walk(rows.select("doc_id", "mark", "text", "n_words", "spans"), run, "doc_id long, mark long, n_removed long, kept binary, kept_text string")


def _salted_semi(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``rows`` whose key is among ``keys``; the rows of one key are dealt to ``SALTS`` tasks.

    Spark takes the salted keys for as small as the file of the keys and would broadcast many times
    its threshold through the driver; hence the hint.
    """
    spread = keys.select(key, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")).hint("merge")
    return rows.withColumn("salt", F.pmod(F.hash("doc_id", "start"), F.lit(SALTS))).join(spread, [key, "salt"], "left_semi").drop("salt")


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> tuple[DataFrame, DataFrame]:
    """All rows as (doc_id, mark, n_words, whole), and those that lose words as _cut gives them."""
    parsed = materialise(_parsed(docs, id_col, text_col), "parsed")
    row = ["doc_id", "mark"]
    stretches = parsed.filter("doc_id is not null").select(*row, F.explode("stretches").alias("x")).select(*row, "x.*")
    # aggregates are written before they are joined back: only a join of two plain shuffles can have
    # its hot keys split at run time
    shared = materialise(stretches.groupBy("core").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").select("core"), "shared")
    live = materialise(stretches.join(shared, "core", "left_semi"), "live")
    named = materialise(live.groupBy("core", "body").agg(F.min("doc_id").alias("low")), "named")
    # of equal stretches those in the smallest document stay; joining these, and not the many others,
    # a hot passage makes few rows
    stay = materialise(live.join(named.select("core", "body", F.col("low").alias("doc_id")), ["core", "body", "doc_id"], "left_semi"), "stay")
    several = materialise(named.groupBy("core").agg(F.min("body").alias("least"), F.max("body").alias("most")).filter("least < most").select("core"), "several")
    apart = _salted_semi(stay, several, "core").groupBy(*row).agg(F.collect_list(F.struct("start", "n", "core")).alias("parts"))
    size = parsed.select(*row, "n_words").join(live.select(*row).distinct(), row, "left_semi").distinct()
    texts = materialise(_rows(docs, id_col, text_col).join(size, row), "repeating")
    windows = materialise(_windows(texts.join(apart, row)), "windows")
    name = ["core", "name"]
    least = materialise(windows.groupBy(*name).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high"), "least")
    found = windows.join(least, name).filter("doc_id > low").select(*row, "start", F.lit(1).alias("n"))
    codes = [df.select(*row, _packed(k).alias("code")) for k, df in enumerate((live, stay, found))]
    count = lambda k: F.count_if(F.col("code") % _KINDS == k)
    spans = codes[0].unionByName(codes[1]).unionByName(codes[2]).groupBy(*row).agg(F.collect_list("code").alias("spans"), count(0).alias("all"), count(1).alias("stay"), count(2).alias("found"))
    spans = spans.filter("`all` > stay or found > 0").select(*row, "spans")
    cut = materialise(_cut(texts.join(spans, row), with_text), "cut")
    return parsed.select(*row, "n_words", "whole"), cut.dropDuplicates(row)


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    rows, cut = find_repeats(docs, id_col, text_col)
    out = rows.join(cut, ["doc_id", "mark"], "left")
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.lower(F.hex(F.coalesce("kept", "whole"))).alias("kept_sha256"))


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without repeated words, with their columns; one that loses every word goes.

    A text that loses words becomes its kept words, joined by one space, and ``n_chars`` follows it.
    """
    _, cut = find_repeats(docs, id_col, text_col, with_text=True)
    row, mark, kept = (free_name(docs.columns, c) for c in ("row_id", "mark", "kept"))
    cut = cut.select(F.col("doc_id").alias(row), F.col("mark").alias(mark), F.col("kept_text").alias(kept))
    out = docs.join(cut, (docs[id_col] == cut[row]) & (F.xxhash64(docs[text_col]) == cut[mark]), "left")
    out = out.filter(F.col(kept).isNull() | (F.col(kept) != ""))
    changed = {text_col: F.coalesce(kept, text_col)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col(kept).isNotNull(), F.length(kept).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumns(changed).select(*docs.columns)
