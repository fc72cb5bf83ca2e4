"""Blocking by Hamming LSH over record Bloom filters, and by Lambda-fold LSH."""

from __future__ import annotations

import math
import random
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.strings import bit_strings, bloom_bits, bloom_length, qgrams
from tessera.operators.blocks import shared_blocks


def mean_lengths(a: DataFrame, b: DataFrame, attributes: Sequence[str], rows: int = 10_000) -> DataFrame:
    """One row: for each attribute the mean length over the first rows of both parties, truncated."""
    first = [p.orderBy(F.col("rec_id").cast("long"), "rec_id").limit(rows) for p in (a, b)]
    return first[0].unionByName(first[1]).agg(*[F.floor(F.sum(F.length(c)) / F.count(F.lit(1))).cast("long").alias(c) for c in attributes])


def filter_lengths(a: DataFrame, b: DataFrame, attributes: Sequence[str], hashes: int = 30, share: float = 0.5) -> list[int]:
    means = mean_lengths(a, b, attributes).first()
    return [bloom_length(int(means[c]), hashes, share) for c in attributes]


@dataclass(frozen=True)
class Layout:
    """Where bits go: what is kept of each attribute's filter, the shuffle, and the sampled positions.

    All of it follows from the seed, is small, and stands in the plan as literals.
    """

    lengths: tuple[int, ...]
    kept: tuple[tuple[int, ...], ...]
    shuffle: tuple[int, ...]
    samples: tuple[tuple[int, ...], ...]

    @staticmethod
    def make(lengths: Sequence[int], sample_percent: Sequence[float], bits: int, iterations: int, seed: int = 42) -> Layout:
        rng = random.Random(seed)
        kept = tuple(tuple(sorted(rng.sample(range(n), math.ceil(p / 100.0 * n)))) for n, p in zip(lengths, sample_percent, strict=True))
        total = sum(lengths)
        shuffle = list(range(total))
        rng.shuffle(shuffle)
        return Layout(tuple(lengths), kept, tuple(shuffle), tuple(tuple(rng.sample(range(total), bits)) for _ in range(iterations)))

    def places(self, attribute: int) -> list[int]:
        """For each bit of the attribute's filter its place in the record's filter, -1 if it isn't kept."""
        before, kept = sum(self.lengths[:attribute]), set(self.kept[attribute])
        return [self.shuffle[before + b] if b in kept else -1 for b in range(self.lengths[attribute])]


def value_filters(values: DataFrame, attributes: Sequence[str], lengths: Sequence[int], hashes: int, layout: Layout | None = None) -> DataFrame:
    """(attributes, bits): the bits of each combination of values, sampled, offset and shuffled by a layout.

    Grams are hashed once each, not once per record: names have few. A record's rows stay in one
    partition, so its bits meet again without a shuffle.
    """
    kinds = range(len(attributes) if layout else 1)
    lists = [F.transform(F.array_distinct(qgrams(F.col(a))), _marker(k if layout else 0)) for k, a in enumerate(attributes)]
    rows = values.select(*attributes, F.explode(F.array_distinct(F.concat(*lists))).alias("g")).select(*attributes, "g.k", "g.gram")
    bits = F.lit(None)
    for k in kinds:
        own = bloom_bits(F.col("gram"), hashes, lengths[k])
        bits = F.when(F.col("k") == k, _placed(own, layout.places(k)) if layout else own).otherwise(bits)
    known = rows.select("k", "gram").distinct().withColumn("bits", bits)
    return rows.join(known, ["k", "gram"]).groupBy(*attributes).agg(F.array_distinct(F.flatten(F.collect_list("bits"))).alias("bits"))


def _marker(k: int):
    return lambda g: F.struct(F.lit(k).alias("k"), g.alias("gram"))


def _placed(bits: Column, places: Sequence[int]) -> Column:
    at = F.array(*[F.lit(p) for p in places])
    return F.filter(F.transform(bits, lambda b: F.get(at, b)), lambda b: b >= 0)


@dataclass
class HammingLsh:
    """Keys of ``bits`` sampled positions, ``iterations`` of them; strict leaves the iteration out of the key."""

    attributes: Sequence[str]
    lengths: Sequence[int]
    sample_percent: Sequence[float]
    bits: int = 45
    iterations: int = 40
    hashes: int = 30
    seed: int = 42
    strict: bool = False

    def index(self, party: DataFrame) -> DataFrame:
        layout = Layout.make(self.lengths, self.sample_percent, self.bits, self.iterations, self.seed)
        # a record's filter is made once per distinct combination of values
        values = party.select(*self.attributes).distinct()
        filters = value_filters(values, self.attributes, self.lengths, self.hashes, layout)
        keyed = filters.select(*self.attributes, bit_strings(F.col("bits"), layout.samples, sum(layout.lengths)).alias("keys"))
        if not self.strict:
            keyed = keyed.withColumn("keys", F.transform("keys", lambda k, i: F.concat(i.cast("string"), F.lit("_"), k)))
        return party.select("rec_id", *self.attributes).join(keyed, list(self.attributes)).select(F.explode("keys").alias("block"), "rec_id")

    def match(self, a: DataFrame, b: DataFrame) -> DataFrame:
        return shared_blocks(a, b)


@dataclass
class LambdaFoldLsh:
    """``folds`` groups, each sampling ``bits`` positions of one Bloom filter over all q-grams of the attributes."""

    attributes: Sequence[str]
    folds: int = 5
    bits: int = 30
    length: int = 2000
    hashes: int = 30
    seed: int = 0
    #: A column of set bits that parties bring along, instead of filters made of the attributes.
    clks: str | None = None

    def samples(self) -> list[list[int]]:
        rng = random.Random(self.seed)
        return [rng.sample(range(self.length), self.bits) for _ in range(self.folds)]

    def index(self, party: DataFrame) -> DataFrame:
        if self.clks:
            keys = bit_strings(F.col(self.clks), self.samples(), self.length)
            return party.select(F.explode(F.transform(keys, lambda k, i: F.concat(i.cast("string"), F.lit("_"), k))).alias("block"), "rec_id")
        filters = value_filters(party.select(*self.attributes).distinct(), self.attributes, [self.length], self.hashes)
        keyed = filters.select(*self.attributes, bit_strings(F.col("bits"), self.samples(), self.length).alias("keys"))
        keyed = keyed.withColumn("keys", F.transform("keys", lambda k, i: F.concat(i.cast("string"), F.lit("_"), k)))
        return party.select("rec_id", *self.attributes).join(keyed, list(self.attributes)).select(F.explode("keys").alias("block"), "rec_id")

    def match(self, a: DataFrame, b: DataFrame) -> DataFrame:
        return shared_blocks(a, b)
