"""Metaphone, which Spark doesn't have built in, over distinct values in Arrow batches."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rewriting rules in order: (pattern, replacement) on upper-case letters.
_RULES = [(re.compile(p), r) for p, r in (
    (r"[^A-Z]", ""), (r"([^C])\1+", r"\1"), (r"^(KN|GN|PN|AE|WR)", lambda m: m[0][1]), (r"^X", "S"), (r"X", "KS"), (r"^WH", "W"), (r"MB$", "M"),
    (r"SCH", "SK"), (r"TCH", "CH"), (r"(?<!S)CIA", "XIA"), (r"CH", "X"), (r"C(?=[IEY])", "S"), (r"C", "K"), (r"DG(?=[EIY])", "J"), (r"D", "T"),
    (r"GH(?=[^AEIOU]|$)", ""), (r"GN(ED)?$", "N"), (r"G(?=[IEY])", "J"), (r"G", "K"), (r"(?<=[AEIOU])H(?![AEIOU])", ""), (r"(?<=[CSPTG])H", "H"),
    (r"PH", "F"), (r"Q", "K"), (r"S(?=I[OA])|SH", "X"), (r"T(?=I[OA])", "X"), (r"TH", "0"), (r"V", "F"),
    (r"W(?![AEIOU])", ""), (r"Y(?![AEIOU])", ""), (r"Z", "S"), (r"(?<!^)[AEIOU]", ""), (r"([A-Z0])\1+", r"\1"),
)]


def metaphone_of(word: str | None) -> str:
    out = (word or "").upper()
    for pattern, to in _RULES:
        out = pattern.sub(to, out)
    return out


def metaphone(c: Column) -> Column:
    @F.pandas_udf("string")
    def run(words: pd.Series) -> pd.Series:
        return words.map({w: metaphone_of(w) for w in words.unique()})

    return run(c)
