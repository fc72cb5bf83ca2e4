"""Signatures over a stream: keys are projections of a row, so they need no state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tessera.operators.psig import signatures
from tessera.sources.parties import ATTRIBUTES


def stream_signatures(party: DataFrame, specs: Sequence[str], attributes: Sequence[str] = ATTRIBUTES) -> DataFrame:
    """(block, rec_id) of a streaming party; frequency limits belong to the table it is written to."""
    if not party.isStreaming:
        raise ValueError("a streaming DataFrame is expected")
    return signatures(party, specs, attributes)
