"""URL filters (native): host/path rules, and for the rest a ratio of character language models.

Two smoothed variable-order Markov models (orders 0 to 2, each order interpolated with the next lower
one by Witten-Bell weights) describe accepted and rejected URLs; a URL's score is the mean over its
characters of log P(accepted) - log P(rejected). URLs that a rule decides teach the models, but for a
quarter of them, by a hash of the URL: on those, which the models haven't seen, the threshold is
calibrated as the score, in steps of 0.01, with the best balanced accuracy.

Characters are folded to a fixed alphabet, so both models together are one dense table of
``len(ALPHABET) ** 3`` rows whatever the corpus: that bound is why it may be broadcast.

Defined cases: a null url or one without ``://`` has empty host and path and matches no rule; the
models read the whole URL, query and fragment too, and a null as the empty string; with no training row of one class every score is that of a uniform
model, and with no calibration row of one class the threshold is 0; repeated rows are judged alike; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed values: (verdict, host, path) of the rules.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Fold of the characters: ``^`` stands before a URL, ``$`` after it, ``*`` for any other character.
ALPHABET = "^$*" + LOWER + "0123456789" + "./-_=&?%:#~+,"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
STEP = 0.01


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def with_rules(pages: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Adds host, path, rule and ruled (its verdict); of the rules that fit, the longest wins."""
    out = pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rule, ruled = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, ruled = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(ruled)
    return out.withColumns({"rule": rule, "ruled": ruled})


def _calibrates(text: Column) -> Column:
    """A quarter of the URLs: those whose md5 starts with 0 to 3."""
    return F.md5(text) < "4"


def _folded(text: Column) -> Column:
    """Two start marks, the characters in the alphabet, one end mark."""
    known = ALPHABET[3:]
    return F.concat(F.lit("^^"), F.regexp_replace(F.translate(text, UPPER, LOWER), "[^" + known.replace("-", r"\-") + "]", "*"), F.lit("$"))


def _grams(rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row per character: its code as ``(first * n + second) * n + third``."""
    n = len(ALPHABET)
    code = F.transform(F.split("chars", ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    at = F.sequence(F.lit(1), F.length("chars") - 2)
    grams = F.transform(at, lambda i: (F.element_at("codes", i) * n + F.element_at("codes", i + 1)) * n + F.element_at("codes", i + 2))
    return rows.withColumn("codes", code).select(*keep, F.explode(grams).alias("gram"))


def _interpolated(table: DataFrame, side: str, seen: DataFrame) -> DataFrame:
    """Adds ``p_<side>``: P(third | first, second) with Witten-Bell interpolation down to order 0."""
    n = len(ALPHABET)
    seen = seen.filter(F.col("side") == side).select("gram", "n")
    last = seen.groupBy((F.col("gram") % n).alias("z")).agg(F.sum("n").alias("n_z"))
    every = Window.partitionBy()
    last = seen.sparkSession.range(n).select(F.col("id").cast("int").alias("z")).join(F.broadcast(last), "z", "left").na.fill(0, ["n_z"])
    last = last.withColumns({"n_all": F.sum("n_z").over(every), "t_all": F.count_if(F.col("n_z") > 0).over(every)})
    pair = seen.groupBy((F.col("gram") % (n * n)).alias("yz")).agg(F.sum("n").alias("n_yz"))
    after = pair.groupBy(F.expr(f"yz div {n}").alias("y")).agg(F.sum("n_yz").alias("n_y"), F.count(F.lit(1)).alias("t_y"))
    context = seen.groupBy(F.expr(f"gram div {n}").alias("xy")).agg(F.sum("n").alias("n_xy"), F.count(F.lit(1)).alias("t_xy"))
    out = table
    for part, key in ((last, "z"), (pair, "yz"), (after, "y"), (context, "xy"), (seen.withColumnRenamed("n", "n_xyz"), "gram")):
        out = out.join(F.broadcast(part), key, "left")
    out = out.na.fill(0)
    p0 = (F.col("n_z") + F.col("t_all") * F.lit(1.0 / n) + F.lit(1.0 / n)) / (F.col("n_all") + F.col("t_all") + 1)
    p1 = (F.col("n_yz") + (F.col("t_y") + 1) * p0) / (F.col("n_y") + F.col("t_y") + 1)
    p2 = (F.col("n_xyz") + (F.col("t_xy") + 1) * p1) / (F.col("n_xy") + F.col("t_xy") + 1)
    return out.withColumn(f"p_{side}", p2).drop("n_all", "t_all", "n_z", "n_yz", "n_y", "t_y", "n_xy", "t_xy", "n_xyz")


def fit(training: DataFrame) -> DataFrame:
    """The dense model table (gram, ratio) from rows (chars, side), side being allow or block."""
    n = len(ALPHABET)
    seen = materialise(_grams(training, ["side"]).groupBy("side", "gram").agg(F.count(F.lit(1)).alias("n")), "url-grams")
    table = training.sparkSession.range(n**3).select(
        F.col("id").cast("int").alias("gram"),
        F.expr(f"cast(id % {n} as int)").alias("z"),
        F.expr(f"cast(id % {n * n} as int)").alias("yz"),
        F.expr(f"id div {n} % {n}").alias("y"),
        F.expr(f"id div {n}").alias("xy"),
    )
    for side in ("allow", "block"):
        table = _interpolated(table, side, seen)
    return materialise(table.select("gram", F.round(F.log("p_allow") - F.log("p_block"), 9).alias("ratio")), "url-model")


def score(rows: DataFrame, model: DataFrame, key: str) -> DataFrame:
    """(key, score): the mean log ratio over the characters of ``chars``.

    Characters meet the broadcast model where they are; only a partial sum per URL is shuffled.
    """
    hit = _grams(rows, [key]).join(F.broadcast(model), "gram")
    return hit.groupBy(key).agg(F.round(F.sum("ratio") / F.count(F.lit(1)), 6).alias("score"))


def calibrate(scored: DataFrame) -> float:
    """The threshold of best balanced accuracy over rows (score, side, n); scores below it are rejected.

    The histogram has at most 4,001 steps, so sorting it in one place is bounded.
    """
    step = F.greatest(F.least(F.floor(F.col("score") / STEP), F.lit(2000)), F.lit(-2000)).cast("long")
    bins = scored.groupBy(step.alias("step")).agg(F.sum(F.when(F.col("side") == "allow", F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("side") == "block", F.col("n")).otherwise(0)).alias("b")).collect()
    bins.sort(key=lambda r: r["step"])
    all_a, all_b = sum(r["a"] for r in bins), sum(r["b"] for r in bins)
    if not all_a or not all_b:
        return 0.0
    best, at, a, b, before = -1.0, 0.0, 0, 0, None
    for r in bins:
        value = (all_a - a) / all_a + b / all_b
        if value > best:
            # between the scores on either side of the cut lies a gap, which is halved
            best, at = value, STEP * (r["step"] if before is None else (before + 1 + r["step"]) / 2)
        a, b, before = a + r["a"], b + r["b"], r["step"]
    return at


def judge_urls(pages: DataFrame, id_col: str = "page_id", rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """id, host, path, rule, verdict and score of every row of ``pages``.

    Distinct URLs are scored once, in full, and joined back, so a URL that a third of the pages share
    costs one score. Host and path serve the rules only.
    """
    judged = with_rules(pages.select(id_col, "url"), rules)
    text = F.coalesce("url", F.lit(""))
    training = judged.filter(F.col("ruled").isNotNull() & ~_calibrates(text)).select(_folded(text).alias("chars"), F.col("ruled").alias("side"))
    model = fit(training)
    texts = judged.select(text.alias("text"), "ruled").groupBy("text", "ruled").agg(F.count(F.lit(1)).alias("n"))
    texts = texts.select("text", "ruled", "n", _folded(F.col("text")).alias("chars"))
    scores = materialise(score(texts.select("text", "chars"), model, "text"), "url-scores")
    known = texts.filter(F.col("ruled").isNotNull() & _calibrates(F.col("text"))).join(scores, "text").select("score", F.col("ruled").alias("side"), "n")
    cut = calibrate(known)
    out = judged.withColumn("text", text).join(scores, "text", "left")
    verdict = F.coalesce("ruled", F.when(F.col("score") >= cut, F.lit("allow")).otherwise(F.lit("block")))
    return out.select(id_col, "host", "path", "rule", verdict.alias("verdict"), "score")
