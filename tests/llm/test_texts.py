"""Operators over documents against brute force, on small tables with awkward rows."""

import hashlib
import os
import pickle
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

pytest.importorskip("tessera.llm")

from tessera.llm import decontam, minhash, packing, substring, text  # noqa: E402
from tessera.operators.components import connected_components  # noqa: E402


def words(n, seed, vocabulary=4000):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def documents():
    base, passage = words(400, 1), words(70, 2)
    near = list(base)
    near[200] = "other"
    rows = [(k, " ".join(words(random.Random(k).randrange(20, 300), 100 + k))) for k in range(20)]
    rows += [(20, " ".join(base)), (21, " ".join(near)), (22, " ".join(base)), (23, " ".join(base[:150] + passage)), (24, "x y " + " ".join(passage) + " tail")]
    rows += [(25, None), (26, ""), (27, " \t\n"), (28, "one two"), (29, "one two"), (30, "é ß 漢字 \x00 " + "\U0001f600 " * 60), (31, "a " * 500), (32, "a " * 300), (33, "a b " * 200)]
    rows += [(34, "  ".join(base).upper()), (20, " ".join(base)), (None, " ".join(base)), (35, " ".join(words(20_000, 9)))]
    return rows


def frame(spark, rows, **extra):
    df = spark.createDataFrame([Row(doc_id=d, text=t) for d, t in rows], "doc_id long, text string")
    return df.withColumn("n_words", F.lit("clash")).withColumn("kept", F.lit(1)).withColumn("mark", F.lit(2)).withColumn("_gone", F.lit(3)).repartition(3)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_substrings_match_brute_force(spark):
    rows = documents()
    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    first = {}
    for d, w in split:
        for s in range(len(w) - 49):
            key = tuple(w[s : s + 50])
            if d is not None:
                first[key] = min(d, first.get(key, d))
    expected = []
    for d, w in split:
        gone = set()
        for s in range(len(w) - 49):
            if d is not None and first[tuple(w[s : s + 50])] < d:
                gone.update(range(s, s + 50))
        expected.append((d, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    got = [tuple(r) for r in substring.digest(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_salted_keys_are_not_broadcast(spark, tmp_path):
    """A small file of keys is many rows once they are salted: too many for the driver."""
    keys, rows = spark.range(1000).selectExpr("xxhash64(id) core"), spark.range(3000).selectExpr("id doc_id", "0 start", "xxhash64(id % 2000) core")
    for df, name in ((keys, "keys"), (rows, "rows")):
        df.write.parquet(f"file://{tmp_path}/{name}")
    keys, rows = (spark.read.parquet(f"file://{tmp_path}/{name}") for name in ("keys", "rows"))
    found = substring._salted_semi(rows, keys, "core")
    assert sorted(r["doc_id"] for r in found.collect()) == [k for k in range(3000) if k % 2000 < 1000]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_substrings_random_shared_passages(spark):
    rng = random.Random(5)
    pool = [words(rng.randrange(45, 90), 1000 + k, 50) for k in range(12)]
    rows = []
    for d in range(120):
        parts = [rng.choice(pool) if rng.random() < 0.6 else words(rng.randrange(5, 60), 5000 + 7 * d + k, 50) for k in range(rng.randrange(1, 6))]
        rows.append((d, " ".join(x for p in parts for x in p)))
    split = [(d, t.split()) for d, t in rows]
    first = {}
    for d, w in split:
        for s in range(len(w) - 49):
            first.setdefault(tuple(w[s : s + 50]), d)
    expected = {}
    for d, w in split:
        gone = {k for s in range(len(w) - 49) if first[tuple(w[s : s + 50])] < d for k in range(s, s + 50)}
        expected[d] = (len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.digest(frame(spark, rows)).collect()}
    assert got == expected
    assert sum(x[1] > 0 for x in expected.values()) > 40


def test_anchors_are_the_first_least():
    rng = np.random.default_rng(3)
    for width in (1, 2, 5, substring.PLACES):
        keys = rng.integers(0, 6, 200).astype(np.uint64)
        assert substring._first_least(keys, width).tolist() == [s + int(keys[s : s + width].argmin()) for s in range(200 - width + 1)]


def test_a_stretch_has_one_name_wherever_it_stands():
    """Also behind 20 million words, where places once ran out of bits."""
    rng = np.random.default_rng(5)
    passage = rng.integers(0, 2**63, 200).astype(np.uint64)
    far = np.concatenate([np.tile(rng.integers(0, 2**63, 1 << 12).astype(np.uint64), 5000), passage])
    names = [{(int(c), int(b)) for c, b in zip(core, body, strict=True)} for _, _, core, body in (substring.stretches_of([passage])[0], substring.stretches_of([far])[0])]
    assert len(far) > 1 << 24 and len(names[0] & names[1]) >= len(names[0]) - 2 > 5


@pytest.mark.parametrize("most", [1, 40, 10**6])
def test_words_in_blocks(most):
    for d, t in documents():
        t = (t or "").encode()
        assert [w for block in text.word_blocks(t, most) for w in block] == t.split()


def test_drop_repeats_with_clashing_names(spark):
    base = " ".join(words(80, 1))
    docs = spark.createDataFrame([(1, base, "a", 1, 2, "k"), (2, "x " + base, "b", 3, 4, "l")], "doc_id long, text string, MARK string, _id int, row_id int, kept string")
    assert sorted(tuple(r) for r in substring.drop_repeats(docs).collect()) == [(1, base, "a", 1, 2, "k"), (2, "x", "b", 3, 4, "l")]


def test_drop_repeats_keeps_columns_and_clean_rows(spark):
    rows = documents()
    docs = frame(spark, rows)
    out = substring.drop_repeats(docs)
    assert out.columns == docs.columns
    got = {(r["doc_id"], r["text"]) for r in out.collect()}
    assert {(d, t) for d, t in rows if d is not None and d < 20 or d in (25, 26, 27, 28, 30)} <= got
    assert 22 not in {d for d, _ in got}
    assert substring.drop_repeats(docs.limit(0)).count() == 0


def brute_components(rows, shingle=5):
    sets, nodes = {}, {}
    out = []
    for d, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        s = {tuple(w[k : k + shingle]) for k in range(len(w) - shingle + 1)} if len(w) >= shingle else {tuple(w)} if w else set()
        out.append((d, s))
        if d is not None:
            sets.setdefault(d, []).append(s)
            nodes[d] = d

    def find(x):
        while nodes[x] != x:
            x = nodes[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = find(a), find(b)
                nodes[max(p, q)] = min(p, q)
    return sorted(((d, len(s), find(d) if d is not None else None, d is None or find(d) == d) for d, s in out), key=str)


@pytest.mark.parametrize("shingle", [4, 5])
def test_near_duplicates_match_brute_force(spark, shingle):
    rows = documents()
    got = sorted((tuple(r) for r in minhash.near_duplicates(frame(spark, rows), shingle=shingle).collect()), key=str)
    assert got == brute_components(rows, shingle)


@pytest.mark.parametrize("block", [minhash.BLOCK_BYTES, 4000])
def test_near_duplicates_of_a_hot_group(spark, block):
    """A group of copies around one text, in one block and in many with hubs and stragglers."""
    rng, base = random.Random(3), words(150, 77)
    rows = []
    for d in range(90):
        w = list(base)
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((d, " ".join(w)))
    rows += [(100 + k, " ".join(words(80, 900 + k))) for k in range(30)]
    got = minhash.near_duplicates(frame(spark, rows), block_bytes=block, hubs=4)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_components(rows)


def test_a_common_frame_makes_no_cluster(spark):
    """300 texts that share 60 of 135 words (similarity 0.26) don't flow together before they are compared."""
    frame_words = words(60, 321)
    rows = [(d, " ".join(frame_words + words(75, 7000 + d, 10**6))) for d in range(300)]
    rows += [(1000 + d, " ".join(frame_words + words(75, 7000 + d, 10**6)[:-1] + ["end"])) for d in range(40)]
    docs = frame(spark, rows)
    sig = minhash.signatures(docs, "doc_id", "text", 5)
    classes = sig.select(F.col("doc_id").alias("rep"), "a", "b", "sketch")
    largest = [connected_components(minhash.pointers(classes, least)).groupBy("component").count().agg(F.max("count")).first()[0] for least in (0, minhash.LIKELY)]
    assert largest[0] > 100 and largest[1] <= 4
    assert sorted((tuple(r) for r in minhash.near_duplicates(docs).collect()), key=str) == brute_components(rows)


def test_pairs_at_the_threshold_become_candidates(spark):
    """Of pairs with a similarity of 0.80 to 0.82 at least 99 in 100 stand in one candidate cluster."""
    rng = random.Random(19)
    rows = []
    for k in range(300):
        base = words(180, 20_000 + k, 10**6)
        near, far = list(base), 0
        while True:
            trial = list(near)
            trial[rng.randrange(len(trial))] = f"y{rng.randrange(10**9)}"
            s, t = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (base, trial))
            if len(s & t) < 0.8 * len(s | t):
                break
            near = trial
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(near))]
    sig = minhash.signatures(frame(spark, rows), "doc_id", "text", 5)
    found = {(r["a"], r["b"]) for r in minhash.pointers(sig.select(F.col("doc_id").alias("rep"), "a", "b", "sketch")).collect()}
    assert sum((2 * k + 1, 2 * k) in found for k in range(300)) >= 297


def test_drop_near_duplicates(spark):
    docs = frame(spark, documents())
    out = minhash.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    ids = [r["doc_id"] for r in out.select("doc_id").collect()]
    assert {25, 26, 27, 28}.issubset(ids) and not {21, 22, 29, 34} & set(ids)
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def items():
    a, b = words(40, 501), words(30, 502)
    return [(1, " ".join(a)), (10, " ".join(b)), (2, " ".join(a[5:25]) + " extra"), (3, "short item here"), (4, ""), (5, None), (6, "..."), (7, "here"), (None, " ".join(words(20, 503)))]


def brute_hits(rows, bench):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    norm = lambda t: re.findall(pattern.encode(), (t or "").encode().lower())
    windows = {}
    for item, t in bench:
        w = norm(t)
        n = min(13, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[s : s + n]), set()).add("" if item is None else str(item))
    out = []
    for d, t in rows:
        w, hit, found = norm(t), set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if (who := windows.get(tuple(w[s : s + n]))) is not None:
                    hit.update(range(s, s + n))
                    found |= who
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("shard", [decontam.SHARD_WORDS, 45, 17])
def test_decontamination_matches_brute_force(spark, shard):
    """One shard, and several small ones, one of which is less than an item."""
    a = items()[0][1].split()
    rows = documents() + [(50, "pre " + " ".join(a[3:20]).upper() + " mid " + " ".join(a[:14]) + " post"), (51, "a SHORT-item, here! " + "z " * 400), (52, " ".join(a[:12])), (53, " ".join(a))]
    bench = spark.createDataFrame(items(), "item_id long, text string")
    got = decontam.digest(decontam.mark(frame(spark, rows), bench, shard_words=shard))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_hits(rows, items())


def test_clean_cuts_passages_and_drops_contaminated(spark):
    a = items()[0][1].split()
    long = words(900, 600)
    rows = [(1, " ".join(long[:400] + a[:20] + long[400:])), (2, " ".join(a)), (3, " ".join(long)), (4, None), (5, "")]
    docs = frame(spark, rows).withColumn("n_chars", F.length("text").cast("long"))
    bench = spark.createDataFrame([(1, " ".join(a)), (9, None)], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontam.clean(docs, bench).collect()}
    assert sorted(got) == [1, 3, 4, 5] and got[3]["text"] == " ".join(long)
    assert got[1]["text"] == " ".join(long[:400]) + "  " + " ".join(long[400:]) and got[1]["n_chars"] == len(got[1]["text"])
    assert decontam.clean(docs, bench.limit(0)).count() == 5 and decontam.clean(docs.limit(0), bench).count() == 0


def test_clean_with_clashing_names(spark):
    a = items()[0][1]
    docs = spark.createDataFrame([(1, a, "s", 1, 2, "i", 3), (2, "fine text", "t", 4, 5, "j", 6)], "doc_id long, text string, spans string, h1 int, H2 int, items string, N_WORDS int")
    bench = spark.createDataFrame(items(), "item_id long, text string")
    for words in (decontam.SHARD_WORDS, 20):
        marked = decontam.mark(docs, bench, shard_words=words)
        assert set(docs.columns) < set(marked.frame.columns) and decontam.digest(marked).filter("contaminated").count() == 1
    assert [tuple(r) for r in decontam.clean(docs, bench).collect()] == [(2, "fine text", "t", 4, 5, "j", 6)]


def test_a_worker_unpacks_the_automaton_once(spark):
    """Two tasks that one worker runs share what it has unpacked."""
    shared = spark.sparkContext.broadcast(decontam.Automaton([("1", items()[0][1].encode())]))
    seen = spark.sparkContext.parallelize(range(8), 8).mapPartitions(lambda _: [(os.getpid(), id(shared.value))]).collect()
    assert all(len({i for p, i in seen if p == pid}) == 1 for pid, _ in seen) and len({p for p, _ in seen}) < 8


def test_automaton_in_bounded_memory():
    """At most two states a word, in flat arrays; many items that share a window cost one entry each."""
    rng = random.Random(4)
    text = [(str(k), " ".join(f"w{rng.randrange(20_000)}" for _ in range(400)).encode()) for k in range(50)]
    machine = decontam.Automaton(text)
    assert len(machine.link) <= 2 * 20_000 + 1 and len(pickle.dumps(machine)) < 100 * 20_000
    common = " ".join(words(20, 71)).encode()
    machine = decontam.Automaton([(str(k), common) for k in range(3000)])
    assert machine.spans(common.split())[1] == {str(k) for k in range(3000)} and len(pickle.dumps(machine)) < 300_000


def test_automaton_on_random_words():
    rng = random.Random(8)
    for _ in range(60):
        bench = [(str(k), " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 30)))) for k in range(5)]
        text = " ".join(rng.choice("abcd") for _ in range(200))
        spans, found = decontam.Automaton([(n, t.encode()) for n, t in bench], 5).spans([w.encode() for w in text.split()])
        w, hit, who = text.split(), set(), set()
        for name, t in bench:
            x = t.split()
            n = min(5, len(x))
            for s in range(len(x) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == x[s : s + n]:
                        hit.update(range(p, p + n))
                        who.add(name)
        assert {k for a, b in zip(spans[::2], spans[1::2]) for k in range(a, b)} == hit and found == who


TOKENIZER = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


@pytest.mark.parametrize(("first", "hand_on"), [(packing.FIRST_ROUND, packing.HAND_ON), (5, 2)])
def test_packing_round_trip(spark, first, hand_on):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    rows = documents() + [(60, "a <|endoftext|> b"), (63, "<|endoftext|><|endoftext|>x<|endoftext"), (64, "<|endoftext|>"), (65, "\n\n<|endoftext|>  y"), (61, "x" * 5000), (62, "don't   stop\n\n 12 ')")]
    ids = [(d, [*t.encode(x or "", add_special_tokens=False).ids, 2]) for d, x in rows]
    expected = []
    for d, v in ids:
        cuts = [0, *range(len(v) % 1024 or 1024, len(v), 1024), len(v)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            expected.append((d, k, a, b - a, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in v[a:b]))))
    got = packing.pack(frame(spark, rows), TOKENIZER, first_round=first, hand_on=hand_on).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(expected, key=str)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(by) <= -(-sum(len(v) for _, v in ids) // 1024) + (2 if hand_on > 20 else 12)
    assert packing.pack(frame(spark, rows).limit(0), TOKENIZER).count() == 0


def test_special_strings_become_their_tokens():
    encode = packing.encoder(TOKENIZER)
    assert encode("a <|endoftext|> b") == [64, 220, 50256, 275]


def test_handing_on_the_emptiest_is_enough(spark):
    """A small bound makes no more sequences than none: the fuller sequences can't take anything more."""
    rng = random.Random(12)
    rows = [(k, " ".join(words(rng.randrange(1, 330), 3000 + k))) for k in range(400)]
    counts = [packing.pack(frame(spark, rows), TOKENIZER, first_round=8, hand_on=n).select("sequence_id").distinct().count() for n in (packing.FAN_IN * 3, 10**6)]
    assert counts[0] <= counts[1]


def test_best_fit_takes_the_fullest_bin_that_fits():
    assert packing.best_fit([6, 5, 4, 3, 2], 10) == [[0, 2], [1, 3, 4]]
