"""Best-fit packing into sequences of at most 1024 tokens, by hierarchical residual packing.

A document's tokens (with an end mark) are one piece, or, if there are more than a sequence holds,
pieces of full length after a first one of the remainder. Full pieces are sequences of their own.
The others are packed best-fit, longest first, within each partition; sequences that are nearly
full leave, and the underfull ones go on, as items, to a round with fewer partitions, where they are
best-fit again, until one partition is left. Only ids, lengths and checksums take part: the text is
read once, and a sequence in the making holds at most 1024 pieces.

What a partition hands on is bounded (``HAND_ON`` sequences, the emptiest), so no task ever gathers
more than ``FAN_IN * HAND_ON`` items, however large the corpus. The bound costs nothing: of a
partition's sequences only one can be at most half full, so in each later round at most ``FAN_IN``
of those that meet can be put into another, and what fits into a fuller sequence fits into one of the
``FAN_IN`` times as many rounds emptiest ones too.

Defined cases: a null or empty text is a piece of one token, the end mark; a null id is kept; rows
that share an id are packed as documents of their own; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import json
import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import chunks, walk
from tessera.session import materialise

CAPACITY = 1024
END_ID = 2
#: A sequence this full, as a share of the capacity, leaves before the last round.
NEARLY_FULL = 0.995
FAN_IN = 8
HAND_ON = 20_000
#: Pieces per partition of the first round.
FIRST_ROUND = 50_000
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
MEMBERS = "array<struct<doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint>>"
BIN = f"round int, sequence_id long, total long, done boolean, members {MEMBERS}"

_encoders: dict[str, object] = {}


def encoder(path: str):
    """Text to token ids as ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)`` gives
    them, held once per worker. Strings of added tokens in a text become those tokens, as there.

    A byte-level BPE stored as a ``.json`` file for *tokenizers* whose ranks lie beside it, as
    ``.tiktoken``, is run by *tiktoken*: the ids are the same, in a quarter of the time. Added tokens
    with rules of their own (white space stripped, whole words) are left to *tokenizers*.
    """
    if path not in _encoders:
        ranks = path.removesuffix(".json") + ".tiktoken"
        with open(path, "rb") as f:
            added = json.load(f).get("added_tokens", [])
        plain = not any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
        if plain and os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            special = {t["content"]: t["id"] for t in added}
            made = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=special)
            _encoders[path] = lambda text: made.encode(text, allowed_special="all")
        else:
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            _encoders[path] = lambda text: t.encode(text, add_special_tokens=False).ids
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of every document: where they start, how long they are, crc32 of their ids."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in chunks(batches, "text"):
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array([*encode(text or ""), end_id], dtype="<u4")
                at, k = 0, 0
                end = len(ids) % capacity or capacity
                while at < len(ids):
                    out.append((doc_id, k, at, end - at, zlib.crc32(ids[at:end].tobytes())))
                    at, k, end = end, k + 1, end + capacity
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return walk(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, PIECE)


def best_fit(totals: list[int], capacity: int) -> list[list[int]]:
    """Best-fit over items in the given order: for each bin, the indexes of its items."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms: list[int] = []  # the amounts of room that some bin has, ascending
    for k, n in enumerate(totals):
        at = bisect_left(rooms, n)
        if at == len(rooms):
            b, room = len(bins), capacity
            bins.append([])
        else:
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                del rooms[at]
        bins[b].append(k)
        room -= n
        if not by_room[room]:
            insort(rooms, room)
        by_room[room].append(b)
    return bins


def _round(items: DataFrame, number: int, last: bool, capacity: int, hand_on: int) -> DataFrame:
    """Packs what each partition holds; items are (total, members)."""
    full = capacity if last else int(NEARLY_FULL * capacity)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        # the order of arrival must not matter: a task that runs again packs alike
        rows.sort(key=lambda r: (-r[0], [(m["doc_id"] is not None, m["doc_id"] or 0, m["piece"], m["ids_crc32"]) for m in r[1]]))
        made = []
        for bin_ in best_fit([r[0] for r in rows], capacity):
            made.append((sum(rows[k][0] for k in bin_), [m for k in bin_ for m in rows[k][1]]))
        going = sorted((k for k, x in enumerate(made) if x[0] < full and not last), key=lambda k: (made[k][0], k))[:hand_on]
        going = set(going)
        base = (number << 56) + (TaskContext.get().partitionId() << 32)
        member = pa.list_(pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]))
        for at in range(0, len(made), 5000):
            part = range(at, min(at + 5000, len(made)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([number] * len(part), pa.int32()),
                    pa.array([base + k for k in part], pa.int64()),
                    pa.array([made[k][0] for k in part], pa.int64()),
                    pa.array([k not in going for k in part], pa.bool_()),
                    pa.array([made[k][1] for k in part], member),
                ],
                names=["round", "sequence_id", "total", "done", "members"],
            )

    return walk(items.select("total", "members"), run, BIN)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, first_round: int = FIRST_ROUND, hand_on: int = HAND_ON) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = materialise(pieces(docs, tokenizer, id_col, text_col, capacity, end_id), "pieces")
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    alone = cut.filter(F.col("length") == capacity).select(*names, F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    items = cut.filter(F.col("length") < capacity)
    n = max(1, -(-items.count() // first_round))
    one = F.struct(*names)
    items = items.select(F.col("length").alias("total"), F.array(one).cast(MEMBERS).alias("members"))
    done, number = [], 1
    while True:
        packed = materialise(_round(items.repartition(n, F.xxhash64("members")), number, n == 1, capacity, hand_on), "packed")
        done.append(packed.filter("done"))
        if n == 1:
            break
        items, n, number = packed.filter("not done"), max(1, n // FAN_IN), number + 1
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    before = F.transform("members", lambda m, i: F.aggregate(F.slice("members", F.lit(1), i), F.lit(0).cast("long"), lambda a, x: a + x["length"]))
    placed = out.select("sequence_id", F.explode(F.arrays_zip(F.col("members").alias("m"), before.alias("o"))).alias("x"))
    placed = placed.select(*[F.col(f"x.m.{c}").alias(c) for c in names], "sequence_id", F.col("x.o").alias("offset"))
    return alone.unionByName(placed)
