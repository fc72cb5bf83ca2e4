"""Scalar functions, folds, clusters, sources and sinks against small models in plain Python."""

import gzip
import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import registry, strings
from tessera.functions.phonetic import metaphone_of
from tessera.operators import clustering, metrics, multiparty, psig
from tessera.operators import sorted_neighbourhood as sn
from tessera.operators.blocks import candidate_pairs, ratio_filter
from tessera.operators.components import connected_components
from tessera.operators.ranking import ranked
from tessera.plans import experiments, reports
from tessera.sources import parties, sinks
from tessera.streaming.keys import stream_signatures


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("a", "b", "expected"), [("peter", "pete", 0.727273), ("aaaa", "aaa", 0.666667), ("", "a", 0.0), ("", "", 1.0)])
def test_dice(spark, a, b, expected):
    assert round(value(spark, strings.dice(F.lit(a), F.lit(b))), 6) == expected == round(clustering.dice_python(a, b), 6)


@pytest.mark.parametrize(("a", "b", "expected"), [("", "", 0.0), ("ab", "ab", 1.0), ("kitten", "sitting", 1 - 3 / 7)])
def test_edit_similarity(spark, a, b, expected):
    assert value(spark, strings.edit_similarity(F.lit(a), F.lit(b))) == pytest.approx(expected)


def test_edit_similarity_at_least(spark):
    assert value(spark, strings.edit_similarity_at_least(F.lit("kitten"), F.lit("sitting"), 0.5)) == pytest.approx(1 - 3 / 7)
    assert value(spark, strings.edit_similarity_at_least(F.lit("a"), F.lit("abcdef"), 0.5)) == 0.0
    assert value(spark, strings.edit_similarity_at_least(F.lit("abcd"), F.lit("wxyz"), 0.5)) == pytest.approx(0.25)
    with pytest.raises(ValueError, match="threshold"):
        strings.edit_similarity_at_least(F.lit("a"), F.lit("b"), 0.0)


def test_bloom_bits_and_lengths(spark):
    gram = "ab"
    s, m = (int(h(gram.encode()).hexdigest(), 16) for h in (hashlib.sha1, hashlib.md5))
    assert set(value(spark, strings.bloom_bits(F.lit(gram), 30, 347))) == {(s + i * m) % 347 for i in range(30)}
    assert [strings.bloom_length(n, 30, 0.5) for n in (5, 6, 7)] == [261, 304, 347]
    assert value(spark, strings.bit_strings(F.array(F.lit(3), F.lit(0), F.lit(3)), [[0, 1, 3], [2, 3]], 5)) == ["101", "01"]
    assert value(spark, strings.bit_strings(F.array().cast("array<int>"), [[0, 4]], 5)) == ["00"]


def test_signature_grammar(spark):
    party = spark.createDataFrame([("1", "ann", "li")], "rec_id string, a1 string, a2 string")
    made = lambda spec, strict=False: sorted(r["block"] for r in psig.signatures(party, [spec], ["a1", "a2"], strict).collect())
    assert made("0,0:1,*") == ["ali"] and made("1,5:0,1") == ["?n"] and made("0,q2") == ["an_0", "nn_0"] and made("1,q3") == ["li"]
    assert made("0,q2", True) == ["an_0", "nn_0", "nn_0"]
    assert value(spark, strings.characters_at(F.lit("abcdef"), "1:3")) == "bc" and value(spark, strings.characters_at(F.lit("abc"), "1:")) == "bc"


def test_metaphone_and_registry(spark):
    assert metaphone_of("Knight")[0] == "N" and metaphone_of("phone")[0] == "F" and metaphone_of(None) == ""
    assert metaphone_of("thumb") == metaphone_of("thum")
    registry.register_similarity("same", lambda a, b: (a == b).cast("double"))
    assert value(spark, registry.similarity("same")(F.lit("a"), F.lit("a"))) == 1.0
    assert value(spark, registry.similarity_from_python(lambda a, b: 0.5)(F.lit("a"), F.lit("b"))) == 0.5
    with pytest.raises(ValueError, match="unknown"):
        registry.similarity("nothing")


def test_asof_assignment(spark):
    refs = spark.createDataFrame([(r,) for r in ("b", "d", "f", "é")], "ref string")
    keys = spark.createDataFrame([(k,) for k in ("a", "b", "c", "f", "z", "ê")], "key string")
    for step in (1, 2, 512):
        got = {r["key"]: r["idx"] for r in sn.assign(keys, sn.reference_index(refs), step).collect()}
        assert got == {"a": 0, "b": 1, "c": 1, "f": 3, "z": 3, "ê": 4}


def test_fold_by_similarity():
    rows = list(zip(range(6), (3, 1, 5, 2, 9, 1), (0, 0.9, 0.1, 0.2, 0.95, 0.1), strict=True))
    assert list(sn.fold_by_similarity(rows, 4, 0.8)) == [(0, 2, 9), (3, 5, 12)]
    assert list(sn.fold_by_similarity([], 4, 0.8)) == [] and list(sn.fold_by_similarity(rows[:1], 4, 0.8)) == [(0, 0, 3)]


def merge_by_size(sizes, k):
    """The rule read literally: blocks in order, sizes by age."""
    blocks = [[i] for i in range(len(sizes))]
    size = {(i,): n for i, n in enumerate(sizes)}
    while len(blocks) > 1:
        low = min(size, key=size.get)
        if size[low] >= k:
            break
        s = blocks.index(list(low))
        if s == 0:
            t = 1
        elif s == len(blocks) - 1:
            t = s - 1
        else:
            t = s - 1 if size[tuple(blocks[s - 1])] < size[tuple(blocks[s + 1])] else s + 1
        new = sorted(blocks[s] + blocks[t])
        n = size.pop(tuple(blocks[s])) + size.pop(tuple(blocks[t]))
        size[tuple(new)] = n
        blocks[min(s, t) : max(s, t) + 1] = [new]
    return [(b[0], b[-1], size[tuple(b)]) for b in blocks]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 12), min_size=1, max_size=25), st.integers(1, 20))
def test_fold_by_size(sizes, k):
    assert sn.fold_by_size(sizes, k) == merge_by_size(sizes, k)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 12), max_size=40), st.integers(1, 8))
def test_fold_in_stretches_equals_the_whole(sizes, k):
    assert list(sn.fold_in_stretches(iter(sizes), k)) == (sn.fold_by_size(sizes, k) if sizes else [])


@pytest.mark.parametrize("partitions", [1, 3, 7])
def test_places_and_running_sums(spark, partitions):
    rng = random.Random(partitions)
    rows = [(rng.randrange(20), k, rng.randrange(5)) for k in range(100)]
    df = spark.createDataFrame(rows, "x int, y int, n int")
    got = sorted((r["at"], r["x"], r["y"], r["s"]) for r in ranked(df, ["x", "y"], "at", {"s": "n"}, partitions).collect())
    so_far, expected = 0, []
    for k, (x, y, n) in enumerate(sorted(rows)):
        so_far += n
        expected.append((k + 1, x, y, so_far))
    assert got == expected and ranked(df.limit(0), ["x"], "at").count() == 0


def some_names(n, seed, letters="abcd"):
    rng = random.Random(seed)
    return list(dict.fromkeys("".join(rng.choice(letters) for _ in range(rng.randrange(1, 7))) for _ in range(n)))


@pytest.mark.parametrize("threshold", [0.35, 0.5, 0.8])
def test_nearest_neighbour_clusters_in_spark(spark, threshold):
    """Ties included, which go to the oldest cluster."""
    values = some_names(90, int(threshold * 100), "ab" if threshold < 0.5 else "abc")
    found = clustering.nearest_neighbour_frame(spark.createDataFrame(list(enumerate(values)), "pos int, ref string"), threshold)
    got = {}
    for r in found.collect():
        got.setdefault(r["cluster"], set()).add(r["ref"])
    expected = clustering.nearest_neighbour_clusters(values, threshold)
    assert {frozenset(x) for x in got.values()} == {frozenset(x) for x in expected} and 1 < len(expected) < len(values)
    assert all(values[c] in members for c, members in got.items())


def literal_linkage(values, clusters, sim):
    live = {i: [v] for i, v in enumerate(values)}
    while len(live) > clusters:
        ids = list(live)
        pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :]]
        mean = {(a, b): round(sum(sim(x, y) for x in live[a] for y in live[b]) / (len(live[a]) * len(live[b])), 9) for a, b in pairs}
        best = max(pairs, key=mean.get)
        live[max(len(values), max(ids) + 1)] = live.pop(best[0]) + live.pop(best[1])
    return live


def test_average_linkage_read_literally():
    for seed in range(5):
        values = some_names(30, seed)
        for clusters in (1, 4, 15):
            assert clustering.average_linkage(values, clusters) == literal_linkage(values, clusters, clustering.dice_python)
    assert clustering.average_linkage(["a", "b"], 5) == {0: ["a"], 1: ["b"]} and clustering.average_linkage([], 3) == {}
    with pytest.raises(ValueError, match="at most"):
        clustering.average_linkage(["a", "b", "c"], 1, most=2)


def test_medoids_without_pairs(spark):
    values = some_names(40, 3) + ["aaaa", "aaaaa"]
    df = spark.createDataFrame([(k, k % 3, v) for k, v in enumerate(values)], "pos int, cluster int, ref string")
    expected = {}
    for c in range(3):
        own = [v for k, v in enumerate(values) if k % 3 == c]
        expected[c] = max((round(sum(clustering.dice_python(x, y) for y in own) - 1, 9), x) for x in own)[1]
    assert {r["cluster"]: r["ref"] for r in clustering.medoids(df).collect()} == expected


def test_samples_by_frequency(spark):
    keys = spark.range(2000).select(F.when(F.col("id") < 1500, F.lit("often")).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key"))
    drawn = [parties.sample_values(keys, 5, seed) for seed in range(12)]
    assert all(len(set(x)) == 5 for x in drawn) and drawn[0] == parties.sample_values(keys, 5, 0) and sum("often" in x for x in drawn) >= 10
    with pytest.raises(ValueError, match="wanted"):
        parties.sample_values(keys, 52)


def test_repeated_ids_and_many_files(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"p{k}.csv").write_text("ENTID,name\n" + "".join(f"{i},N{i}{k}\n" for i in range(4)))
    both = parties.load_parties(spark, [str(tmp_path / f"p{k}.csv") for k in range(3)], ["entid", "a1"], "entid")
    assert sorted((r["party"], r["rec_id"], r["a1"]) for r in both.collect()) == [(k, str(i), f"n{i}{k}") for k in range(3) for i in range(4)]
    (tmp_path / "bad.csv").write_text("id,name\n1,a\n1,b\n")
    with pytest.raises(ValueError, match="more than once"):
        parties.load_party(spark, str(tmp_path / "bad.csv"), ["id", "a1"], "id")


def test_configured_methods(spark):
    a = spark.createDataFrame([("1", "anna", "li"), ("2", "bob", "ng"), ("3", "anne", "li")], "rec_id string, a1 string, a2 string")
    b = spark.createDataFrame([("7", "anna", "li"), ("8", "zoe", "xu")], "rec_id string, a1 string, a2 string")
    config = {"signatureSpecs": [[{"type": "characters-at", "config": {"pos": ["0:2"]}, "feature": "a1"}]], "blocking-filter": {"type": "bloom filter", "number-hash-functions": 4, "bf-len": 2048}}
    ma, mb = psig.ConfiguredSignature(config).index_both(a, b)
    assert sorted(r["rec_id"] for r in ma.collect()) == ["1", "3"] and [r["rec_id"] for r in mb.collect()] == ["7"]
    del config["blocking-filter"]
    assert psig.ConfiguredSignature(config).index_both(a, b)[0].count() == 3
    fold = experiments.from_config({"type": "lambda-fold", "config": {"blocking-features": [1, 2], "Lambda": 2, "K": 3, "bf-len": 50}})
    assert (fold.attributes, fold.folds, fold.bits, fold.length, fold.hashes, fold.seed) == (("a1", "a2"), 2, 3, 50, 30, 0) and fold.index(a).count() == 6
    clks = experiments.from_config({"type": "lambda-fold", "config": {"Lambda": 2, "K": 3, "bf-len": 50, "input-clks": True}})
    rows = spark.createDataFrame([("1", [0, 7, 49]), ("2", [])], "rec_id string, clk array<int>")
    expected = {(f"{k}_" + "".join("1" if p in bits else "0" for p in sample), rec) for rec, bits in (("1", {0, 7, 49}), ("2", set())) for k, sample in enumerate(clks.samples())}
    assert {(r["block"], r["rec_id"]) for r in clks.index(rows).collect()} == expected


def literal_windows(a, b, w):
    values = sorted(set(a) | set(b))
    out = set()
    for i in range(len(values) - 2 * w + 1):
        j = i + 2 * w
        while (sum(v in a for v in values[i:j]) < w or sum(v in b for v in values[i:j]) < w) and j < len(values):
            j += 1
        out |= {(x, y) for x in values[i:j] if x in a for y in values[i:j] if y in b}
    return out


def test_two_party_windows(spark):
    rng = random.Random(2)
    for w, n in ((1, 6), (2, 9), (2, 3), (3, 12)):
        a, b = ({rng.choice("abcdefghijklmnopqr") for _ in range(n)} for _ in range(2))
        frames = [spark.createDataFrame([(v,) for v in x], "ref string") for x in (a, b)]
        ranked = sn.windows(*frames, w)
        got = {(r["a_ref"], r["b_ref"]) for r in sn.window_pairs(ranked, sn.window_ends(ranked, w), w).collect()}
        assert got == literal_windows(a, b, w)


def test_clusters():
    sim = {frozenset("ab"): 0.9, frozenset("bc"): 0.5, frozenset("ac"): 0.2, frozenset("de"): 0.7}
    f = lambda x, y: 1.0 if x == y else sim.get(frozenset((x, y)), 0.0)
    assert clustering.nearest_neighbour_clusters("abc", 0.4, f) == [["a", "b", "c"]]
    assert clustering.nearest_neighbour_clusters("abc", 0.6, f) == [["a", "b"], ["c"]]
    assert clustering.average_linkage("abcde", 3, f) == {2: ["c"], 5: ["a", "b"], 6: ["d", "e"]}
    assert clustering.average_linkage("abcde", 1, f)[8] == ["d", "e", "c", "a", "b"] or len(clustering.average_linkage("abcde", 1, f)) == 1


def test_noise_never_matches(spark):
    refs = clustering.clusters_frame(spark, {0: ["ann"], 1: ["bob"]})
    keys = spark.createDataFrame([("1", "ann"), ("2", "bobby"), ("3", "zzz")], "rec_id string, key string")
    method = clustering.HierarchicalClustering(refs, 50.0, 0.3)
    members = method.padded(method.index(keys))
    assert members.filter("fake").count() == method.noise(method.index(keys)).agg(F.sum("fakes")).first()[0] > 0
    assert {r["block"]: (r["na"], r["nb"]) for r in method.match(members, members).collect()} == {0: (2, 2), 1: (1, 1)}


def test_disclosure_risk_and_components(spark):
    rng = random.Random(4)
    members = [(f"b{rng.randrange(8)}", f"r{rng.randrange(20)}") for _ in range(90)]
    df = spark.createDataFrame(members, "block string, rec_id string")
    blocks = {}
    for b, r in members:
        blocks.setdefault(b, set()).add(r)
    expected = {r: 1 / len(set.intersection(*[s for s in blocks.values() if r in s])) for _, r in members}
    assert {r["rec_id"]: pytest.approx(r["risk"]) for r in metrics.disclosure_risk(df).collect()} == expected
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(k, k + 1) for k in range(100, 140)] + [(5, 5), (None, 1)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        if a is not None and a != b:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_csv_parties(spark, tmp_path):
    text = "id,Name , city\n7, ANN,X \n8,Bob\t,\n9,c,d\n"
    (tmp_path / "p.csv").write_text(text)
    with gzip.open(tmp_path / "q.csv.gz", "wt") as f:
        f.write(text)
    for name in ("p.csv", "q.csv.gz"):
        got = parties.load_party(spark, str(tmp_path / name), ["id", "name", "city"], "id")
        assert sorted((r["rec_id"], r["name"], r["city"]) for r in got.collect()) == [("7", "ann", "x"), ("8", "bob", ""), ("9", "c", "d")]
        assert parties.repeated_ids(got).count() == 0 and parties.repeated_ids(got.union(got)).count() == 3
    numbered = parties.load_party(spark, str(tmp_path / "p.csv"), ["id", "name", "city"])
    assert {r["rec_id"]: r["id"] for r in numbered.collect()} == {"0": "7", "1": "8", "2": "9"}
    assert parties.dataset_catalogue("nc")[0][0] == "datasets/ncvoter-temporal-1.csv" and len(parties.dataset_catalogue("mod", (4611, 46116, 461167), (25, 50, 75))) == 9
    assert parties.dataset_catalogue("mod") == [("datasets/1730_50_overlap_no_mod_alice.csv.gz", "datasets/1730_50_overlap_with_mod_bob_1.csv.gz")]
    assert parties.dataset_catalogue("nc_syn_mod")[4] == ("datasets/54886_50_overlap_no_mod_alice.csv", "datasets/54886_50_overlap_with_mod_bob_2.csv") and len(parties.dataset_catalogue("syn_mod")) == 9
    keys = spark.createDataFrame([(k,) for k in "aaabbc"], "key string")
    assert sorted(parties.sample_values(keys, 3)) == ["a", "b", "c"]
    with pytest.raises(ValueError, match="distinct"):
        parties.sample_values(keys, 4)


def test_sinks_reports_and_experiment(spark, tmp_path):
    a = spark.createDataFrame([(str(k), str(k), f"n{k % 7}", "x") for k in range(60)], "rec_id string, ent_id string, a1 string, a2 string")
    b = a.filter("cast(rec_id as int) < 30")
    method = psig.PSignature(["0,*"], attributes=["a1", "a2"])
    row = experiments.run_experiment(spark, "psig", a, b, lambda: method.index(a), lambda: method.index(b), k=3)
    r = row.first()
    assert row.columns == list(sinks.RESULT_COLUMNS) and r["pc"] == 1.0 and r["rr"] == pytest.approx(1 - r["num_cand_rec_pairs"] / 1800)
    assert r["tot_time"] >= r["dbo_time"] and r["num_blocks"] == 7
    sinks.append_result(row, str(tmp_path / "r"))
    sinks.append_result(row.withColumn("Method", F.lit("other")), str(tmp_path / "r"))
    table = parties.load_table(spark, str(tmp_path / "r"))
    assert table.count() == 2
    changed = sinks.update_result(table, row.withColumn("pc", F.lit(0.5)))
    assert {x["Method"]: x["pc"] for x in changed.collect()} == {"psig": 0.5, "other": 1.0}
    sinks.write_results(changed, str(tmp_path / "w"))
    sinks.write_block_sizes(method.index(a), str(tmp_path / "s"))
    sinks.write_blocks(method.index(a), str(tmp_path / "b"))
    assert spark.read.text(str(tmp_path / "b")).count() == 7 and spark.read.csv(str(tmp_path / "s"), header=True).count() == 7
    assert reports.error_bars(table, "a").count() == 2 and reports.ratios(table, "other").count() == 1 and reports.runtimes(table).count() == 2
    empty = metrics.assess(a.limit(0), b.limit(0), candidate_pairs(method.index(a.limit(0)), method.index(b))).first()
    assert (empty["rr"], empty["pc"], empty["pq"]) == (-1.0, -1.0, -1.0)
    assert ratio_filter(method.index(a), 60, 0.1, 0.16).select("block").distinct().count() == 7


def test_many_parties(spark):
    records = parties.many_parties(spark, "/root/testdata/sf0.001")
    members = records.select("party", F.substring("a1", 1, 2).alias("block"), "rec_id")
    rows, lines = experiments.run_many_parties(spark, records, members, (3, 4))
    got = {r["k"]: r for r in rows.collect()}
    held, sizes = {}, {}
    for r in members.collect():
        held.setdefault(r["block"], {}).setdefault(r["party"], []).append(r["rec_id"])
        sizes[r["party"]] = sizes.get(r["party"], 0) + 1
    for k in (3, 4):
        total = 0
        for by in held.values():
            if len(by) >= k:
                p = 1
                for x in by.values():
                    p *= len(x)
                total += p
        assert got[k]["NUMBER_OF_COMPARISON"] == total and 0 <= got[k]["SC"] <= 1
        assert lines[k].count() == sum(len(by) >= k for by in held.values())
    assert reports.subset_matching(rows).first()["k"] == 3
    assert multiparty.true_sets(records, 5).count() == 0


def test_configured_filters_and_sounds(spark):
    a = spark.createDataFrame([("1", "smith", "li"), ("2", "smyth", "li")], "rec_id string, a1 string, a2 string")
    part = lambda kind, f, **c: {"type": kind, "feature": f} | c
    config = {"signatureSpecs": [[part("metaphone", "a1")], [part("characters-at", "a1", config={"pos": [0, "1:2"]})]], "filter": {"type": "ratio", "min": 0.4, "max": 1.0}}
    method = experiments.from_config({"type": "p-sig", "config": config})
    method.columns = ("a1", "a2")
    assert method.index(a).count() == 4
    fold = experiments.from_config({"type": "lambda-fold", "config": {"blocking-features": ["a1", "a2"], "Lambda": 3, "K": 10, "bf-len": 200, "num-hash-funcs": 5, "random_state": 0}})
    assert fold.index(a).count() == 6
    with pytest.raises(ValueError, match="unknown"):
        experiments.from_config({"type": "x", "config": {}})


def test_streaming_keys(spark, tmp_path):
    a = spark.createDataFrame([("1", "ann", "li"), ("2", "bob", "xu")], "rec_id string, a1 string, a2 string")
    a.write.parquet(str(tmp_path / "in"))
    stream = stream_signatures(spark.readStream.schema(a.schema).parquet(str(tmp_path / "in")), ["0,0:1,*"], ["a1", "a2"])
    q = stream.writeStream.format("memory").queryName("keys").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["block"] for r in spark.table("keys").collect()) == ["ali", "bxu"]
    with pytest.raises(ValueError, match="streaming"):
        stream_signatures(a, ["0,0"], ["a1", "a2"])
