"""The pipeline's stages against brute force, each on what its predecessor kept."""

import os
import re
import zlib

import pytest
from pyspark.sql import functions as F

pytest.importorskip("tessera.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tests.llm.test_models import literal_quality  # noqa: E402
from tests.llm.test_texts import TOKENIZER, brute_components, brute_hits  # noqa: E402

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    outs = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, outs[-1], SF)
        out.write.parquet(f"file://{tmp_path}/{name}")
        outs.append(spark.read.parquet(f"file://{tmp_path}/{name}"))
        if name != "packing":
            assert outs[-1].columns == columns
    first, good, unique, cut, clean = (rows_of(x) for x in outs[:5])

    scores = literal_quality(list(first.items()), [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()])
    assert good == {d: t for d, t in first.items() if scores[d] >= 0.7} and len(good) < len(first)

    components = {d: kept for d, _, _, kept in brute_components(list(good.items()))}
    assert unique == {d: t for d, t in good.items() if components[d]} and len(unique) < len(good)

    split = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in unique.items()}
    owner = {}
    for d in sorted(split):
        for s in range(len(split[d]) - 49):
            owner.setdefault(tuple(split[d][s : s + 50]), d)
    expected = {}
    for d, w in split.items():
        gone = {k for s in range(len(w) - 49) if owner[tuple(w[s : s + 50])] < d for k in range(s, s + 50)}
        left = " ".join(x for k, x in enumerate(w) if k not in gone)
        if not gone or left:
            expected[d] = left if gone else unique[d]
    assert cut == expected

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hits = {d: (hit, bad) for d, _, hit, _, _, bad in brute_hits(list(cut.items()), items)}
    assert set(clean) == {d for d in cut if not hits[d][1]} and any(bad for _, bad in hits.values())
    assert all(clean[d] == cut[d] for d in clean if not hits[d][0])
    assert not any(h for _, _, h, _, _, _ in brute_hits([x for x in clean.items() if hits[x[0]][0]], items))

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    pieces = {}
    for d, x in clean.items():
        v = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range(len(v) % 1024 or 1024, len(v), 1024), len(v)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            pieces[d, k] = (a, b - a, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in v[a:b])))
    packed = outs[5].collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in packed} == pieces
    assert corpus_pipeline.run(spark, SF).count() == len(pieces)


def test_stages_with_odd_rows(spark, tmp_path):
    """Nulls, repeats, a long text, an empty table and clashing columns, through all stages."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    long = " ".join(f"{w} {k}" for k, w in enumerate(("the river runs through town and on to the sea " * 3000).split()))
    odd = spark.createDataFrame([(9001, None, None, None, None), (9002, "", "en", "s", 0), (9003, " \t\n", "en", "s", 3), (9004, long, "en", "s", len(long)), (None, "one two three", None, "s", 13), (9002, "", "en", "s", 0)], docs.schema)
    clash = {c: F.lit(k) for k, c in enumerate(("score", "_score", "_gone", "mark", "row_id", "KEPT", "n_words", "spans", "items", "h1", "component_id", "rep", "total", "members"))}
    wide = docs.unionByName(odd).withColumns(clash)
    for rows in (wide, wide.limit(0)):
        out = rows
        for name, stage in corpus_pipeline.STAGES[:-1]:
            path = f"file://{tmp_path}/{name}-{rows is wide}"
            stage(spark, out, SF).write.parquet(path)
            out = spark.read.parquet(path)
            assert out.columns == wide.columns
        kept = {r["doc_id"] for r in out.collect()}
        pieces = corpus_pipeline.STAGES[-1][1](spark, out, SF).collect()
        assert {r["doc_id"] for r in pieces} == kept and (len(kept) > 100 if rows is wide else not kept)
        assert out.select(*clash).distinct().count() <= 1


def test_run_leaves_only_its_stages(spark):
    from tessera import session

    folder = session.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    corpus_pipeline.run(spark, SF)
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before}
    assert left == {"stage-quality", "stage-near_duplicates", "stage-substrings", "stage-decontamination", "pieces", "packed"}
