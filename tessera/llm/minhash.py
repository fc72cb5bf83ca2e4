"""MinHash near-dedup with tensored banding, and exact verification.

A document's set holds its distinct shingles of five words (a parameter). Two collections of ``SIDE`` sub-keys, each of
``ROWS`` minhashes, are computed per set; every pair of a first and a second sub-key makes the key of
one table, so 2 * SIDE sub-keys serve SIDE * SIDE tables. At a Jaccard similarity of 0.8 two sets
meet in some table with probability (1 - (1 - 0.8**2)**10)**2 > 0.9999.

1. Equal sets become one class, whose smallest document stands for it.
2. Classes that share a first sub-key with another enter the tables; in each bucket all point at its
   smallest member. A pointer stays if at least ``LIKELY`` of the minhashes agree, kept as one byte
   each: at a similarity of 0.8 all but one in 10**4 do, at 0.28 one in 10**4 does, so that texts which
   share no more than a frame don't flow together. What pointers join is a candidate cluster. A link
   is lost if every bucket where its ends meet is led by a text like neither; such a bucket's key is
   all of it out of what many texts share, and of the 64 in 100 tables where they meet few are.
3. Within a cluster, sets are compared in full, in blocks of bounded bytes. A few hubs stand in every
   block of a large cluster; what is then not in the cluster's main component is put into blocks of
   its own and compared with all others. Workers search breadth-first and hand on a spanning forest,
   never all pairs.

Defined cases: a null or blank text has an empty set and links with nothing; with fewer words than
a shingle has the whole sequence is the one shingle; rows that share an id are one document; a row
whose id is null has no component and is kept; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import U64, WordHashes, chunks, mix, walk
from tessera.operators.components import connected_components
from tessera.session import materialise

SHINGLE = 5
SIDE, ROWS = 10, 2
#: Links need ``PARTS[1] * intersection >= PARTS[0] * union``.
PARTS = (80, 100)
#: How many of the minhashes of a pointer's ends must agree.
LIKELY = 22
#: Text in a block, and the share of it that hubs may take.
BLOCK_BYTES = 2 << 20
HUBS, HUB_SHARE = 48, 0.25
_ODD = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=U64)
_SEEDS = mix(np.arange(1, 2 * SIDE * ROWS + 1, dtype=U64) * _ODD[0])


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Ascending distinct hashes of the k-word shingles of a sequence of word hashes."""
    n = len(words)
    if n == 0:
        return words
    size = min(k, n)
    h = np.full(n - size + 1, U64(size), dtype=U64)
    for j in range(size):
        h = mix(h * _ODD[1] + words[j : n - size + 1 + j])
    return np.unique(h)


def minhashes(shingles: np.ndarray) -> np.ndarray:
    """The minimum of each permutation of the hashes, in bounded memory."""
    low = np.full(len(_SEEDS), ~U64(0), dtype=U64)
    for at in range(0, len(shingles), 4096):
        part = shingles[at : at + 4096]
        low = np.minimum(low, ((part[None, :] ^ _SEEDS[:, None]) * _ODD[2]).min(axis=1))
    return low


def sub_keys(shingles: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Both collections of sub-keys, as signed 64-bit numbers, and a byte of each minhash."""
    low = minhashes(shingles)
    sketch = (mix(low) & U64(0xFF)).astype(np.uint8).view(np.int8).tolist()
    low = low.reshape(2 * SIDE, ROWS)
    keys = np.zeros(2 * SIDE, dtype=U64)
    for j in range(ROWS):
        keys = mix(keys * _ODD[3] + low[:, j])
    keys = keys.view(np.int64).tolist()
    return keys[:SIDE], keys[SIDE:], sketch


def signatures(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """doc_id, n_shingles, size (bytes of text), lo and hi (fingerprint of the set), a and b (sub-keys), sketch."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int8()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in chunks(batches, "text"):
            out = []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                s = shingle_set(hashes.of_text(text.lower()), shingle) if text else np.zeros(0, U64)
                if len(s):
                    m = mix(s + _ODD[4])
                    out.append((len(s), len(text), int(m.sum(dtype=U64).view(np.int64)), int(np.bitwise_xor.reduce(m * _ODD[5]).view(np.int64)), *sub_keys(s)))
                else:
                    out.append((0, len(text or b""), 0, 0, None, None, None))
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_shingles", "size", "lo", "hi", "a", "b", "sketch"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return walk(rows, run, "doc_id long, n_shingles long, size long, lo long, hi long, a array<long>, b array<long>, sketch array<tinyint>")


def likely(a: Column, b: Column, least: int) -> Column:
    """Whether at least so many bytes of two sketches agree."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) >= least


def pointers(classes: DataFrame, least: int = LIKELY) -> DataFrame:
    """(a, b): classes that share a table key with another, and the smallest class there, if they are likely alike."""
    firsts = materialise(classes.select("rep", F.posexplode("a").alias("i", "key")), "first-keys")
    # aggregates are written before they are joined back: only a join of two plain shuffles can have
    # its hot keys split at run time
    shared = materialise(firsts.groupBy("i", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("i", "key"), "shared-keys")
    live = firsts.join(shared, ["i", "key"], "left_semi")
    tables = live.join(classes.select("rep", "b"), "rep").select("rep", "i", "key", F.posexplode("b").alias("j", "other"))
    tables = materialise(tables.select("rep", F.xxhash64("i", "j", "key", "other").alias("key")), "tables")
    centers = materialise(tables.groupBy("key").agg(F.min("rep").alias("center"), F.max("rep").alias("last")).filter("center < last"), "centers")
    met = materialise(tables.join(centers, "key").filter("rep <> center").select(F.col("rep").alias("a"), F.col("center").alias("b")).distinct(), "pointers")
    if least <= 0:
        return met
    of = lambda end: classes.select(F.col("rep").alias(end), F.col("sketch").alias(f"of_{end}"))
    return met.join(of("a"), "a").join(of("b"), "b").filter(likely(F.col("of_a"), F.col("of_b"), least)).select("a", "b")


def _links_in(table: pa.Table, shingle: int, hashes: WordHashes) -> list[tuple[int, int]]:
    """A spanning forest of the links among the rows (rep, text, probe) of a block.

    Where some rows are probes, only links with a probe are searched for.
    """
    reps = table.column("rep").to_pylist()
    sets = [shingle_set(hashes.of_text(t.lower()), shingle) for t in table.column("text").cast(pa.binary()).to_pylist()]
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    names, codes = np.unique(np.concatenate(sets), return_inverse=True)
    holders = np.repeat(np.arange(len(sets)), sizes)[np.argsort(codes, kind="stable")]
    stops = np.cumsum(np.bincount(codes, minlength=len(names)))
    starts = stops - np.bincount(codes, minlength=len(names))
    probes = np.array(table.column("probe").to_pylist(), bool)
    n = len(sets)
    waiting = np.ones(n, bool)
    out = []

    def linked(a: int) -> np.ndarray:
        mine = codes[ends[a] - sizes[a] : ends[a]]
        met = np.concatenate([holders[starts[c] : stops[c]] for c in mine])
        both = np.bincount(met, minlength=n)
        return PARTS[1] * both >= PARTS[0] * (sizes[a] + sizes - both)

    if probes.any():
        root = list(range(n))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for a in np.flatnonzero(probes).tolist():
            for b in np.flatnonzero(linked(a)).tolist():
                if (x := find(a)) != (y := find(b)):
                    root[x] = y
                    out.append((reps[a], reps[b]))
        return out
    for first in range(n):
        if not waiting[first]:
            continue
        waiting[first] = False
        queue = [first]
        while queue and waiting.any():
            a = queue.pop()
            found = np.flatnonzero(linked(a) & waiting)
            waiting[found] = False
            queue += found.tolist()
            out += [(reps[a], reps[b]) for b in found.tolist()]
    return out


def _compare(rows: DataFrame, keys: list[str], shingle: int) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        links = _links_in(table, shingle, WordHashes())
        return pa.table({"a": pa.array([x[0] for x in links], pa.int64()), "b": pa.array([x[1] for x in links], pa.int64())})

    return rows.groupBy(*keys).applyInArrow(run, "a long, b long")


def _links(docs: DataFrame, clusters: DataFrame, classes: DataFrame, id_col: str, text_col: str, shingle: int, block_bytes: int, hubs: int) -> DataFrame:
    """Links (a, b) that connect what true links connect."""
    clusters = clusters.join(classes.select(F.col("rep").alias("node"), "size"), "node")
    shape = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.min_by("node", F.xxhash64("node", F.lit(7))).alias("first"))
    shape = shape.select("cluster", "first", F.ceil(F.col("bytes") / block_bytes).cast("long").alias("blocks"), F.least(F.lit(float(hubs)) / F.col("n"), F.lit(HUB_SHARE * block_bytes) / F.col("bytes")).alias("share"))
    placed = clusters.join(materialise(shape, "cluster-shapes"), "cluster")
    chance = F.pmod(F.xxhash64("node", F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    placed = placed.select("node", "cluster", "size", "blocks", F.pmod(F.xxhash64("node"), "blocks").alias("block"), ((chance < F.col("share")) | (F.col("node") == F.col("first"))).alias("hub"))
    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text")).join(placed, "node")
    texts = materialise(texts.dropDuplicates(["node", "text"]), "candidates")
    rows = texts.select(F.col("node").alias("rep"), "text", "cluster", "block", "blocks", "hub", F.lit(False).alias("probe"))
    own = rows.select("cluster", "block", "rep", "text", "probe")
    spread = rows.filter("hub and blocks > 1").select("cluster", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("at"), "rep", "text", "probe")
    spread = spread.filter("at <> block").select("cluster", F.col("at").alias("block"), "rep", "text", "probe")
    first = materialise(_compare(own.unionByName(spread), ["cluster", "block"], shingle), "links")
    large = placed.filter("blocks > 1")
    if large.isEmpty():
        return first
    parts = large.join(connected_components(first), "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = parts.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("cluster").agg(F.max_by("component", F.struct(F.col("n"), -F.col("component"))).alias("main"))
    apart = materialise(parts.join(main, "cluster").filter("component <> main").select("node", "cluster", "size"), "apart")
    if apart.isEmpty():
        return first
    # the stragglers in blocks of their own, each of which meets every block of the cluster
    sources = materialise(apart.groupBy("cluster").agg(F.ceil(F.sum("size") / block_bytes).cast("long").alias("sources")), "sources")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = rows.join(apart.join(sources, "cluster").select(F.col("node").alias("rep"), F.pmod(F.xxhash64("node", F.lit(3)), "sources").alias("source")), "rep")
    probes = left.select("cluster", every("blocks").alias("block"), "source", "rep", "text", F.lit(True).alias("probe"))
    against = rows.join(sources, "cluster").select("cluster", "block", every("sources").alias("source"), "rep", "text", "probe")
    return first.unionByName(materialise(_compare(probes.unionByName(against), ["cluster", "block", "source"], shingle), "links"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, block_bytes: int = BLOCK_BYTES, hubs: int = HUBS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    sig = materialise(signatures(docs, id_col, text_col, shingle), "signatures")
    known = sig.filter("doc_id is not null and n_shingles > 0")
    equal = ["n_shingles", "lo", "hi"]
    one = known.groupBy(*equal).agg(F.min(F.struct("doc_id", "size", "a", "b", "sketch")).alias("one"))
    classes = materialise(one.select(*equal, F.col("one.doc_id").alias("rep"), "one.size", "one.a", "one.b", "one.sketch"), "classes")
    clusters = connected_components(pointers(classes)).withColumnRenamed("component", "cluster")
    links = _links(docs, clusters, classes, id_col, text_col, shingle, block_bytes, hubs)
    members = known.select("doc_id", *equal).join(classes.select(*equal, "rep"), equal)
    twice = members.groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low < high")
    twice = members.join(twice, "doc_id").select(F.col("rep").alias("a"), F.col("low").alias("b"))
    component = connected_components(links.unionByName(twice)).withColumnRenamed("node", "rep")
    out = sig.select("doc_id", *equal).join(classes.select(*equal, "rep"), equal, "left").join(component, "rep", "left")
    found = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "rep", "doc_id"))
    return out.select("doc_id", "n_shingles", found.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The documents that stay: one of each group, with their columns."""
    gone = near_duplicates(docs, id_col, text_col, shingle).filter("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
