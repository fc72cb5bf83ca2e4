"""Scalar building blocks as Column expressions: q-grams, similarities, Bloom bits, signatures."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

FIRST_PAD, LAST_PAD = "\x01", "\x02"


def clean_cell(c: Column) -> Column:
    """Lower case, white space of any kind stripped at both ends, null as the empty string."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"^\s+|\s+$", "")


def qgrams(c: Column, q: int = 2) -> Column:
    """The padded q-grams of a string in order, repeats kept."""
    if q < 2:
        return F.when(F.length(c) > 0, F.split(c, "")).otherwise(F.array().cast("array<string>"))
    padded = F.concat(F.lit(FIRST_PAD * (q - 1)), c, F.lit(LAST_PAD * (q - 1)))
    return F.transform(F.sequence(F.lit(1), F.length(c) + q - 1), lambda i: F.substr(padded, i, F.lit(q)))


def dice_of(left: Column, right: Column) -> Column:
    """Dice of two gram lists: distinct common grams over the lists' lengths."""
    return F.lit(2.0) * F.size(F.array_intersect(left, right)) / (F.size(left) + F.size(right))


def dice(a: Column, b: Column, q: int = 2) -> Column:
    return F.when(a == b, F.lit(1.0)).otherwise(dice_of(qgrams(a, q), qgrams(b, q)))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length; 0 if either string is empty, even if both are."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when((a == "") | (b == ""), F.lit(0.0)).when(a == b, F.lit(1.0)).otherwise(F.lit(1.0) - F.levenshtein(a, b) / longer)


def edit_similarity_at_least(a: Column, b: Column, threshold: float) -> Column:
    """Edit similarity where it can reach the threshold.

    If the lengths alone rule that out it is 0; if the distance is beyond what the threshold allows,
    the upper bound 1 - (allowed + 1) / longer length stands for it.
    """
    if not 0.0 < threshold <= 1.0:
        raise ValueError(f"threshold not between 0 and 1: {threshold}")
    longer = F.greatest(F.length(a), F.length(b))
    allowed = (F.lit(1.0) - F.lit(threshold)) * longer
    near = F.lit(1.0) - F.abs(F.length(a) - F.length(b)) / longer
    distance = F.levenshtein(a, b)
    return (
        F.when((a == "") | (b == ""), F.lit(0.0))
        .when(a == b, F.lit(1.0))
        .when(near < threshold, F.lit(0.0))
        .when(distance > allowed, F.lit(1.0) - (allowed + 1) / longer)
        .otherwise(F.lit(1.0) - distance / longer)
    )


def hex_modulo(digest: Column, digits: int, length: int) -> Column:
    """A hexadecimal digest modulo ``length``, folded in 32-bit chunks."""
    chunks = F.sequence(F.lit(0), F.lit(digits // 8 - 1))
    return F.aggregate(
        chunks,
        F.lit(0).cast("long"),
        lambda r, i: (r * F.lit(4294967296 % length).cast("long") + F.conv(F.substr(digest, i * 8 + 1, F.lit(8)), 16, 10).cast("long")) % F.lit(length).cast("long"),
    )


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def bloom_bits(gram: Column, hashes: int, length: int) -> Column:
    """Bit positions (sha1 + i * md5) mod length for i below ``hashes``, repeats dropped."""
    digests = F.struct(F.sha1(gram).alias("s"), F.md5(gram).alias("m"))

    def reduced(d: Column) -> Column:
        return F.struct(hex_modulo(d["s"], 40, length).alias("s"), hex_modulo(d["m"], 32, length).alias("m"))

    def spread(p: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: ((p["s"] + i * p["m"]) % length).cast("int"))

    return F.array_distinct(let(let(digests, reduced), spread))


def bloom_filter(c: Column, hashes: int, length: int, q: int = 2) -> Column:
    """The set bits of a string's q-grams, ascending."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.array_distinct(qgrams(c, q)), lambda g: bloom_bits(g, hashes, length)))))


def bloom_dice(a: Column, b: Column) -> Column:
    """Dice of two Bloom filters given as bit arrays; two empty ones are equal."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(F.lit(2.0) * F.size(F.array_intersect(a, b)) / total)


def bloom_length(mean_length: int, hashes: int, share: float, q: int = 2, padded: bool = True) -> int:
    """Bits needed so that about ``share`` of them are set by strings of the mean length."""
    grams = mean_length - q + 1 + (2 * (q - 1) if padded else 0)
    return math.ceil(1.0 / (1.0 - share ** (1.0 / (hashes * grams))))


def bit_strings(bits: Column, samples: Sequence[Sequence[int]], length: int) -> Column:
    """For each list of positions the bits there as a string of 0 and 1, in one array.

    The bits are laid out once as an array of characters, so that each position costs one look-up.
    """

    def mask(b: Column) -> Column:
        gaps = F.transform(b, lambda x, i: F.concat(F.repeat(F.lit("0"), x - F.when(i == 0, F.lit(-1)).otherwise(F.get(b, i - 1)) - 1), F.lit("1")))
        return F.split(F.rpad(F.array_join(gaps, ""), length, "0"), "")

    def keys(m: Column) -> Column:
        return F.array(*[F.concat(*[F.get(m, F.lit(p)) for p in positions]) for positions in samples])

    return let(let(F.array_sort(F.array_distinct(bits)), mask), keys)


def common_prefix_similarity(a: Column, b: Column, similarity) -> Column:
    """Similarity of the first three quarters of the shorter string's length of both strings."""
    n = F.floor(F.lit(3) * F.least(F.length(a), F.length(b)) / 4).cast("int")
    return similarity(F.substr(a, F.lit(1), n), F.substr(b, F.lit(1), n))


def characters_at(c: Column, where: int | str) -> Column:
    """One character by position, or a slice written ``start:end``; out of range gives what there is."""
    if isinstance(where, int):
        return F.substr(c, F.lit(where + 1), F.lit(1))
    start, _, end = where.partition(":")
    first = int(start or 0)
    return F.substr(c, F.lit(first + 1), F.lit(int(end) - first)) if end else F.substr(c, F.lit(first + 1))


def signature_parts(spec: str) -> list[tuple[int, str]]:
    """``attr,what`` pairs of a signature ``1,0:1,1:2,*``; what is a position, ``*`` or ``qN``."""
    return [(int(a), what) for a, what in (part.split(",") for part in spec.split(":"))]


def _marked_grams(c: Column, q: int, mark: str) -> Column:
    """Unpadded q-grams with a mark; a shorter value stands as it is."""
    at = F.sequence(F.lit(1), F.greatest(F.length(c) - q + 1, F.lit(1)))
    return F.when(F.length(c) < q, F.array(c)).otherwise(F.transform(at, lambda i: F.concat(F.substr(c, i, F.lit(q)), F.lit(mark))))


def signature_values(spec: str, columns: Sequence[Column], strict: bool = False) -> Column:
    """The signatures of one spec as an array: the q-grams of each ``qN`` part and the joined rest.

    ``strict`` repeats the last q-gram once more, as a spec that ends on one is counted elsewhere.
    """
    out, joined = [], None
    last = F.lit("")
    for attr, what in signature_parts(spec):
        c = columns[attr]
        if what.startswith("q"):
            q = int(what[1:])
            grams = _marked_grams(c, q, f"_{attr}")
            out.append(grams)
            last = F.element_at(grams, -1)
            if strict:
                joined = last
        else:
            piece = c if what == "*" else F.when(F.length(c) < int(what) + 1, F.lit("?")).otherwise(F.substr(c, F.lit(int(what) + 1), F.lit(1)))
            joined = piece if joined is None else F.concat(joined, piece)
    if joined is not None:
        out.append(F.when(joined != "", F.array(joined)).otherwise(F.array().cast("array<string>")))
    return F.concat(*out) if len(out) > 1 else out[0]


def laplace_location(mean_size: Column, weight: float, epsilon: float) -> Column:
    """Where the padding noise is centred: -(2 / eps) * ln(2E / (E + w))."""
    return F.lit(-2.0 / epsilon) * F.log(F.lit(2.0) * mean_size / (mean_size + weight))
