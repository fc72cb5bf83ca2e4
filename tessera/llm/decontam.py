"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

Texts are lower-cased (A-Z) and read as words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. The automaton
of all items is walked along a document's words and always knows the longest run of words, ending
here, that some item holds. Where it is 13 or more, the words of the run's last 13 are hit; an item
of fewer words is hit where the whole of it is the end of the run.

The driver builds the automaton once, as flat arrays, in shards of at most ``SHARD_WORDS`` words of
items, which have at most twice as many states of some 30 bytes; a worker unpacks a shard once and keeps
it from task to task. One shard is one pass over the documents. Several shards walk the documents one
after the other and hand on hits only, by a hash of the text, which are then joined to the documents:
items are never dropped, and no copy of the documents is made for a shard. An item longer than a shard
is cut into stretches that overlap by a window.

Defined cases: null texts have no words; items without words match nothing; a null item_id stands as
an empty string in the digest; items that share an id count once; repeated documents are judged alike;
an empty benchmark hits nothing; every document column passes through ``clean`` untouched but for the
text and ``n_chars``, whatever its name.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import NORMAL_WORD, chunks, free_name, walk
from tessera.session import materialise

WINDOW = 13
#: A document is contaminated if at least one in so many of its words is hit.
SHARE = 20
SHARD_WORDS = 1 << 20


class Automaton:
    """Suffix automaton of several word sequences, with the items that hold each window.

    A state's first transition stands in ``char`` and ``to``, any others in ``more``.
    """

    def __init__(self, items: Iterable[tuple[str, bytes]], window: int = WINDOW) -> None:
        self.window, self.vocab = window, {}
        self.root: dict[int, int] = {}
        self.char, self.to = array("i", [-1]), array("i", [-1])
        self.more: dict[int, dict[int, int]] = {}
        self.link, self.length = array("i", [-1]), array("i", [0])
        sequences = []
        for name, text in items:
            words = NORMAL_WORD.findall(text.lower())
            if words:
                ids = array("i", [self.vocab.setdefault(w, len(self.vocab)) for w in words])
                sequences.append((name, ids))
                last = 0
                for c in ids:
                    last = self._extend(last, c)
        self._note(sequences)

    def _step(self, s: int, c: int) -> int:
        """The state after ``c``, or -1."""
        if not s:
            return self.root.get(c, -1)
        if self.char[s] == c:
            return self.to[s]
        others = self.more.get(s)
        return others.get(c, -1) if others else -1

    def _set(self, s: int, c: int, to: int) -> None:
        if not s:
            self.root[c] = to
        elif self.char[s] in (-1, c):
            self.char[s], self.to[s] = c, to
        else:
            self.more.setdefault(s, {})[c] = to

    def _new(self, length: int, link: int) -> int:
        for a, x in ((self.char, -1), (self.to, -1), (self.length, length), (self.link, link)):
            a.append(x)
        return len(self.link) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        new = self._new(self.length[p] + 1, self.link[q])
        self.char[new], self.to[new] = self.char[q], self.to[q]
        if q in self.more:
            self.more[new] = dict(self.more[q])
        self.link[q] = new
        while p >= 0 and self._step(p, c) == q:
            self._set(p, c, new)
            p = self.link[p]
        return new

    def _extend(self, last: int, c: int) -> int:
        q = self._step(last, c)
        if q >= 0:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, c, q)
        new = self._new(self.length[last] + 1, 0)
        p = last
        while p >= 0 and (q := self._step(p, c)) < 0:
            self._set(p, c, new)
            p = self.link[p]
        if p >= 0:
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
        return new

    def _note(self, sequences: list[tuple[str, array]]) -> None:
        size, w, link, length = len(self.link), self.window, self.link, self.length
        order = sorted(range(1, size), key=length.__getitem__)
        # the state of a run's last `window` words, for each state that holds runs that long
        self.base = array("i", [-1]) * size
        for s in order:
            if length[s] >= w:
                self.base[s] = self.base[link[s]] if length[link[s]] >= w else s
        # the items that hold a window, by its state: one stands in `owner`, several in `owners`
        self.names: list[str] = []
        known: dict[str, int] = {}
        self.owner = array("i", [-1]) * size
        self.owners: dict[int, array] = {}
        # items with fewer words than a window that end a run in a state, as (words, item)
        whole: dict[int, list[tuple[int, str]]] = {}
        for name, ids in sequences:
            me = known.setdefault(name, len(self.names))
            if me == len(self.names):
                self.names.append(name)
            s = 0
            for k, c in enumerate(ids):
                s = self._step(s, c)
                if k + 1 >= w:
                    b = self.base[s]
                    if self.owner[b] < 0:
                        self.owner[b] = me
                    elif b not in self.owners:
                        if self.owner[b] != me:
                            self.owners[b] = array("i", [self.owner[b], me])
                    else:
                        self.owners[b].append(me)
            if len(ids) < w:
                whole.setdefault(s, []).append((len(ids), name))
        self.short = array("i", [0]) * size
        self.shorts: list[tuple[tuple[int, str], ...]] = [()]
        for s in order:
            self.short[s] = self.short[link[s]] if link[s] > 0 else 0
            if s in whole:
                self.shorts.append(self.shorts[self.short[s]] + tuple(whole[s]))
                self.short[s] = len(self.shorts) - 1

    def spans(self, words: list[bytes]) -> tuple[list[int], set[str]]:
        """Hit spans as start, end, start, end, ... (ascending, apart) and the items that occur."""
        out: list[int] = []
        names: set[str] = set()
        seen: set[int] = set()
        state, matched = 0, 0
        get, root, char, to, more = self.vocab.get, self.root, self.char, self.to, self.more
        link, length, short, base, w = self.link, self.length, self.short, self.base, self.window
        for i, word in enumerate(words):
            c = get(word)
            if c is None:
                state = matched = 0
                continue
            while state:
                if char[state] == c:
                    state, matched = to[state], matched + 1
                    break
                others = more.get(state)
                if others is not None and c in others:
                    state, matched = others[c], matched + 1
                    break
                state = link[state]
                matched = length[state]
            else:
                # every word of the vocabulary starts at the root
                state, matched = root[c], 1
            if matched >= w:
                _cover(out, i - w + 1, i + 1)
                seen.add(base[state])
            if short[state]:
                for n, name in self.shorts[short[state]]:
                    if n <= matched:
                        _cover(out, i - n + 1, i + 1)
                        names.add(name)
        for s in seen:
            names.update(self.names[k] for k in self.owners.get(s, self.owner[s : s + 1]))
        return out, names


def _cover(out: list[int], start: int, end: int) -> None:
    """Adds a span whose end is past all ends so far."""
    while out and start <= out[-1]:
        start = min(start, out[-2])
        del out[-2:]
    out += (start, end)


def _shards(benchmark: DataFrame, window: int, most: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items in lists of at most ``most`` words; one list is on the driver at a time."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), F.col("text")).filter("text is not null")
    shard, held = [], 0
    for r in rows.toLocalIterator():
        text = r["text"].encode()
        n = sum(1 for _ in NORMAL_WORD.finditer(text.lower()))
        cuts = [(text, n)] if n <= most else _stretches(text, window, most)
        for part, size in cuts:
            if shard and held + size > most:
                yield shard
                shard, held = [], 0
            shard.append((r["name"], part))
            held += size
    yield shard


def _stretches(text: bytes, window: int, most: int) -> Iterator[tuple[bytes, int]]:
    """A long item in stretches of at most ``most`` words that share a window less one word."""
    places = [m.span() for m in NORMAL_WORD.finditer(text.lower())]
    size = max(most, window)
    for k in range(0, len(places) - window + 1, size - window + 1):
        part = places[k : k + size]
        yield text[part[0][0] : part[-1][1]], len(part)


@dataclass
class Marked:
    """Documents with the names of three added columns: words, hit spans (flat), items that occur."""

    frame: DataFrame
    n_words: str
    spans: str
    items: str

    def n_hit(self) -> Column:
        """Words in the spans: the ends less the starts."""
        signed = F.transform(self.spans, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x))
        return F.aggregate(signed, F.lit(0).cast("long"), lambda a, x: a + x)


def _hits(docs: DataFrame, shared: Broadcast, text_col: str) -> DataFrame:
    """(h1, h2, spans, items) of each text that a shard hits, once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans_of = shared.value.spans
        for batch in chunks(batches, "text"):
            rows = []
            for h1, h2, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
                hit, who = spans_of(NORMAL_WORD.findall(text.lower()))
                if hit:
                    rows.append((h1, h2, hit, sorted(who)))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["h1", "h2", "spans", "items"])

    text = F.col(text_col)
    rows = docs.filter(text.isNotNull()).select(F.xxhash64(text).alias("h1"), F.xxhash64(text, F.lit(1)).alias("h2"), text.alias("text"))
    return walk(rows, run, "h1 long, h2 long, spans array<int>, items array<string>").dropDuplicates(["h1", "h2"])


def mark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS, cut: bool = False) -> Marked:
    """``docs`` with their words counted, the spans hit and the items that occur.

    With ``cut`` the hit spans are also taken out of the text.
    """
    context = docs.sparkSession.sparkContext
    shards = [context.broadcast(Automaton(items, window)) for items in _shards(benchmark, window, shard_words)]
    n_words, spans, items = (free_name(docs.columns, c) for c in ("n_words", "spans", "items"))
    empty = {spans: F.array().cast("array<int>"), items: F.array().cast("array<string>")}
    if len(shards) == 1:
        rows = docs.withColumns(empty)
    else:
        found = reduce(DataFrame.unionByName, [materialise(_hits(docs, s, text_col), "hits") for s in shards])
        one, two = free_name(docs.columns, "h1"), free_name(docs.columns, "h2")
        found = found.groupBy(F.col("h1").alias(one), F.col("h2").alias(two)).agg(F.flatten(F.collect_list("spans")).alias(spans), F.array_distinct(F.flatten(F.collect_list("items"))).alias(items))
        rows = docs.withColumns({one: F.xxhash64(text_col), two: F.xxhash64(text_col, F.lit(1))}).join(materialise(found, "hits"), [one, two], "left").drop(one, two)
        rows = rows.withColumns({c: F.coalesce(F.col(c), e) for c, e in empty.items()})
    rows = rows.withColumn(n_words, F.lit(0).cast("long"))
    only = shards[0] if len(shards) == 1 else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans_of = only.value.spans if only else None
        for batch in chunks(batches, text_col):
            names = batch.schema.names
            column = batch.column(names.index(text_col))
            texts = column.cast(pa.binary()).to_pylist()
            counts, hits, who = [], [], []
            for text, old, had in zip(texts, batch.column(names.index(spans)).to_pylist(), batch.column(names.index(items)).to_pylist(), strict=True):
                words = NORMAL_WORD.findall(text.lower()) if text else []
                hit, found = spans_of(words) if spans_of else (_united(old), had)
                counts.append(len(words))
                hits.append(hit)
                who.append(sorted(found))
            if cut and any(hits):
                column = pa.array([cut_spans(t, s) if s else t for t, s in zip(texts, hits, strict=True)], pa.binary()).cast(column.type)
            made = {text_col: column, n_words: pa.array(counts, pa.int64()), spans: pa.array(hits, pa.list_(pa.int32())), items: pa.array(who, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([made.get(n, batch.column(k)) for k, n in enumerate(names)], names=names)

    return Marked(walk(rows, run, rows.schema), n_words, spans, items)


def _united(spans: list[int]) -> list[int]:
    """Spans in any order as spans that ascend and lie apart."""
    out: list[int] = []
    for start, end in sorted(zip(spans[::2], spans[1::2], strict=True)):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += (start, end)
    return out


def digest(marked: Marked, id_col: str = "doc_id", share: int = SHARE) -> DataFrame:
    """id, n_words, n_hit, n_items, items_sha256, contaminated of marked documents."""
    return marked.frame.select(
        id_col,
        F.col(marked.n_words).alias("n_words"),
        marked.n_hit().alias("n_hit"),
        F.size(marked.items).cast("long").alias("n_items"),
        F.sha2(F.array_join(marked.items, ","), 256).alias("items_sha256"),
    ).withColumn("contaminated", F.expr(f"n_hit > 0 and {share} * n_hit >= n_words"))


def cut_spans(text: bytes, spans: list[int]) -> bytes:
    """The text without its hit words and what stands between them."""
    places = [m.span() for m in NORMAL_WORD.finditer(text.lower())]
    out, at = [], 0
    for start, end in zip(spans[::2], spans[1::2], strict=True):
        out.append(text[at : places[start][0]])
        at = places[end - 1][1]
    out.append(text[at:])
    return b"".join(out)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """The documents without those hit over the coverage limit, and the others without hit spans.

    Columns are those of ``docs``; a column ``n_chars`` follows the text.
    """
    marked = mark(docs, benchmark, text_col, window, cut=True)
    hit = marked.n_hit()
    out = marked.frame.filter((hit == 0) | (hit * share < F.col(marked.n_words)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(marked.spans) > 0, F.length(text_col).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
