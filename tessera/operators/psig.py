"""Blocking by probability signatures: keys out of characters and q-grams of the attributes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.phonetic import metaphone
from tessera.functions.strings import bloom_bits, characters_at, signature_values
from tessera.operators.blocks import frequency_filter, ratio_filter, shared_blocks
from tessera.sources.parties import ATTRIBUTES


def signatures(party: DataFrame, specs: Sequence[str], attributes: Sequence[str] = ATTRIBUTES, strict: bool = False) -> DataFrame:
    """(block, rec_id): every signature of every record, one row each; repeats stay."""
    columns = [F.col(a) for a in attributes]
    made = [signature_values(s, columns, strict) for s in specs]
    return party.select(F.explode(F.concat(*made) if len(made) > 1 else made[0]).alias("block"), "rec_id")


def signature_bits(members: DataFrame, hashes: int, length: int) -> DataFrame:
    """(bit): the Bloom filter of all signatures, at most ``length`` rows."""
    distinct = members.select("block").distinct()
    return distinct.select(F.explode(bloom_bits(F.col("block"), hashes, length)).alias("bit")).distinct()


def common_bits(a: DataFrame, b: DataFrame, hashes: int, length: int) -> DataFrame:
    """The bits set in both parties' filters."""
    return signature_bits(a, hashes, length).join(signature_bits(b, hashes, length), "bit", "left_semi")


def in_common_filter(members: DataFrame, bits: DataFrame, hashes: int, length: int) -> DataFrame:
    """Memberships whose signature has all its bits in the common filter.

    The filter has at most ``length`` bits, which bounds the broadcast.
    """
    known = members.select("block").distinct().withColumn("bits", bloom_bits(F.col("block"), hashes, length))
    held = known.select("block", F.size("bits").alias("n"), F.explode("bits").alias("bit")).join(F.broadcast(bits), "bit")
    kept = held.groupBy("block", "n").agg(F.count(F.lit(1)).alias("c")).filter("c = n").select("block")
    return members.join(kept, "block", "left_semi")


@dataclass
class PSignature:
    """Signatures, kept if their frequency is in (low, high], matched on equality."""

    specs: Sequence[str]
    low: int = 0
    high: int = 1 << 30
    hashes: int = 20
    bf_length: int = 2048
    attributes: Sequence[str] = ATTRIBUTES
    strict: bool = False

    def index(self, party: DataFrame) -> DataFrame:
        return frequency_filter(signatures(party, self.specs, self.attributes, self.strict), self.low, self.high)

    def match(self, a: DataFrame, b: DataFrame) -> DataFrame:
        return shared_blocks(a, b)


@dataclass
class ConfiguredSignature:
    """Signatures from a configuration: ``signatureSpecs`` of ``characters-at`` and ``metaphone`` parts,
    a ``filter`` of type ``ratio`` or ``count``, and a ``blocking-filter`` that two parties have in common."""

    config: Mapping[str, object]
    columns: Sequence[str] = ATTRIBUTES

    def _part(self, part: Mapping[str, object]) -> Column:
        c = F.col(self.columns[int(part["feature-idx"]) if "feature-idx" in part else self.columns.index(str(part["feature"]))])
        kind = part["type"]
        if kind == "feature-value":
            return c
        if kind == "metaphone":
            return metaphone(c)
        if kind == "characters-at":
            return F.concat(*[characters_at(c, p) for p in part["config"]["pos"]])
        raise ValueError(f"unknown signature part {kind}")

    def index_both(self, a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Memberships of two parties, of signatures that the common Bloom filter holds if there is one."""
        ma, mb = self.index(a), self.index(b)
        f = self.config.get("blocking-filter")
        if not f:
            return ma, mb
        if f["type"] != "bloom filter":
            raise ValueError(f"unknown blocking filter {f['type']}")
        hashes, length = int(f["number-hash-functions"]), int(f["bf-len"])
        bits = common_bits(ma, mb, hashes, length)
        return in_common_filter(ma, bits, hashes, length), in_common_filter(mb, bits, hashes, length)

    def index(self, party: DataFrame) -> DataFrame:
        specs = self.config["signatureSpecs"]
        keys = [F.concat(F.lit(f"{k}_"), *[self._part(p) for p in spec]) for k, spec in enumerate(specs)]
        members = party.select(F.explode(F.array(*keys)).alias("block"), "rec_id")
        f = self.config.get("filter")
        if not f:
            return members
        if f["type"] == "count":
            return frequency_filter(members, int(f["min"]) - 1, int(f["max"]))
        if f["type"] == "ratio":
            return ratio_filter(members, party.count(), float(f["min"]), float(f["max"]))
        raise ValueError(f"unknown filter {f['type']}")

    def match(self, a: DataFrame, b: DataFrame) -> DataFrame:
        return shared_blocks(a, b)
