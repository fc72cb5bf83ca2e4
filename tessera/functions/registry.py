"""Similarities by name; a caller may register its own."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import strings

Similarity = Callable[[Column, Column], Column]
_SIMILARITIES: dict[str, Similarity] = {"dice": strings.dice, "edit": strings.edit_similarity}


def register_similarity(name: str, builder: Similarity) -> None:
    """``builder`` makes a column in [0, 1] of two string columns."""
    _SIMILARITIES[name] = builder


def similarity(name: str) -> Similarity:
    if name not in _SIMILARITIES:
        raise ValueError(f"unknown similarity {name}; known: {sorted(_SIMILARITIES)}")
    return _SIMILARITIES[name]


def similarity_from_python(function: Callable[[str, str], float]) -> Similarity:
    """A Python function of two strings, run over Arrow batches: the slow way, where no column will do."""
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([function(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return run
