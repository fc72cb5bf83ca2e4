"""Words and hashes shared by the operators that walk over texts in Python workers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Words of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z, on UTF-8 bytes: digits, letters, anything not ASCII.
NORMAL_WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
#: Words of [^\x20\x09-\x0D]+, on UTF-8 bytes.
SPACED_WORD = re.compile(rb"[^\x20\x09-\x0d]+")
#: Bytes of text that are worked on at once in a worker.
CHUNK_BYTES = 1 << 20
#: Bytes of an Arrow batch between Spark and a worker; Spark's own default allows 16 times as many.
BATCH_BYTES = 4 << 20
BATCH_SETTING, BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"

U64 = np.uint64


def held_out(doc_id: Column) -> Column:
    """The fold that nothing learns from: crc32 of the id as text leaves 2 modulo 4. A null id is not in it."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def spaced_words(text: bytes) -> list[bytes]:
    """``bytes.split()`` splits at exactly \\x20 and \\x09-\\x0D."""
    return text.split()


_BLANK = re.compile(rb"[\x20\x09-\x0d]")


def word_blocks(text: bytes, most: int = CHUNK_BYTES) -> Iterator[list[bytes]]:
    """The spaced words of a text in lists of about ``most`` bytes, so that a long text isn't held as words."""
    at = 0
    while at < len(text):
        m = _BLANK.search(text, at + most)
        end = m.start() if m else len(text)
        yield spaced_words(text if end - at == len(text) else text[at:end])
        at = end


class WordHashes:
    """64-bit hashes of words, remembered up to ``limit`` words (a cache: what it forgets is hashed again)."""

    def __init__(self, limit: int = 100_000) -> None:
        self.limit, self.known = limit, {}

    def of(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > self.limit:
            known.clear()
        out = [known.get(w) for w in words]
        if None in out:
            hashed = xxhash.xxh3_64_intdigest
            for k, h in enumerate(out):
                if h is None:
                    w = words[k]
                    out[k] = h = known.get(w)
                    if h is None:
                        out[k] = known[w] = hashed(w)
        return np.array(out, dtype=U64)

    def of_text(self, text: bytes | None) -> np.ndarray:
        """Hashes of a whole text's spaced words."""
        found = [self.of(block) for block in word_blocks(text)] if text else []
        return found[0] if len(found) == 1 else np.concatenate(found) if found else np.zeros(0, U64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def free_name(columns: Iterable[str], wanted: str) -> str:
    """``wanted`` with underscores until no column has the name, in any case of letters."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def walk(df: DataFrame, run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` in bounded memory.

    Rows travel in batches of at most ``BATCH_BYTES`` (unless the session has a setting of its own),
    and a worker gives its free memory back after a task: it stays alive for other stages.
    """
    conf = df.sparkSession.conf
    if conf.get(BATCH_SETTING) == BATCH_DEFAULT:
        conf.set(BATCH_SETTING, str(BATCH_BYTES))

    def trimmed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            gc.collect()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return df.mapInArrow(trimmed, schema)


def chunks(batches: Iterable[pa.RecordBatch], text_col: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about ``most`` bytes of text (one row at least)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.names.index(text_col))), 0)
        at, total = 0, 0
        for k, n in enumerate(sizes.to_pylist()):
            if total and total + n > most:
                yield batch.slice(at, k - at)
                at, total = k, 0
            total += n
        yield batch.slice(at)

