"""Embedding near-dedup: spherical k-means cells, blocked cosine products, one vector kept per group.

Vectors with one label are compared. Equal vectors become one class first, with a count. Each class
has its home in the cell of the nearest centroid and is a guest of every other cell that a vector
linked with it may call home: with ``e`` the distance from the class to the plane between its own
cell and the other, that needs ``e <= sin(angle of the threshold)``. So each home row meets all of
its links in its home cell, whatever the centroids are: they decide the cost, not the result.

A class is a guest only where it lies within reach of every plane that bounds the cell, not just of
its own cell's. Centroids are fitted per label on a bounded sample (``SAMPLE`` vectors of all labels, the
first by a hash of their ids), in two levels: at most ``MOST_CELLS`` cells, each with at most
``MOST_PARTS`` parts, of about ``CELL`` rows; that bounds what is broadcast, and cells grow in number
with the table up to some 10**8 vectors. Cells are cut into blocks of ``BLOCK_BYTES``, nearly always
one; a task holds two blocks at most and hands on a count for each home row and a spanning forest of
the links, never the pairs. Vectors travel as they were given, as floats where they are floats, and
are compared in double precision.

Defined cases: null, empty, zero or non-finite vectors, null labels and null components link with
nothing and are their own group; vectors of unequal length never link; rows that share an id are one
vector whose links are added up; a null id has no links counted and is kept.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from tessera.llm.text import walk
from tessera.operators.components import connected_components
from tessera.session import materialise

THRESHOLD = 0.98
SAMPLE = 40_000
MOST_CELLS, MOST_PARTS = 512, 32
#: Rows a cell should have.
CELL = 6000
BLOCK_BYTES = 4 << 20
ROUNDS = 8
#: Rows that are placed or compared at a time.
STRIP = 256


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of unit rows; seeds are spread by farthest-first choice."""
    seeds, best = [0], x @ x[0]
    for _ in range(1, min(k, len(x))):
        seeds.append(int(best.argmin()))
        best = np.maximum(best, x @ x[seeds[-1]])
    c = x[seeds].copy()
    for _ in range(rounds):
        cell = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, cell, x)
        norm = np.linalg.norm(sums, axis=1)
        c[norm > 0] = sums[norm > 0] / norm[norm > 0, None]
    return c


def valid(rows: DataFrame, vector_col: str, label_col: str) -> DataFrame:
    v = F.col(vector_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.filter(F.col(label_col).isNotNull() & F.coalesce(fine, F.lit(False)))


@dataclass
class Cells:
    """Centroids of the cells of one label and dimension, and of the parts of each cell that has parts."""

    centroids: np.ndarray
    parts: list[np.ndarray | None]


def _matrix(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    """A column of lists of one length as double rows."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def fit_cells(classes: DataFrame, sample: int = SAMPLE, most_cells: int = MOST_CELLS, most_parts: int = MOST_PARTS, cell: int = CELL) -> dict[tuple[int, int], Cells]:
    """Cells by (label, dimension), for those of more than one."""
    counts = {(r["label"], r["dim"]): r["n"] for r in classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cell).orderBy(F.desc("n"), "label", "dim").limit(most_cells).collect()}
    if not counts:
        return {}
    total = sum(counts.values())
    rows = classes.orderBy(F.xxhash64("rep"), "rep").limit(sample).select("label", "dim", "v").toArrow()
    label, dim = rows.column("label").to_numpy(), rows.column("dim").to_numpy()
    out = {}
    for key, n in counts.items():
        at = np.flatnonzero((label == key[0]) & (dim == key[1]))
        k = max(1, min(-(-n // cell), int(most_cells * n / total), len(at)))
        if len(at) < 2:
            continue
        x = unit(_matrix(rows.column("v").take(pa.array(at)), len(at)))
        c = spherical_kmeans(x, k)
        own = (x @ c.T).argmax(axis=1)
        want = min(most_parts, -(-n // (cell * len(c))))
        parts = [spherical_kmeans(x[own == j], want) if want > 1 and (own == j).sum() >= 2 * want else None for j in range(len(c))]
        out[key] = Cells(c, parts)
    return out


def placements(x: np.ndarray, c: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, home): each row's own cell and those that a vector linked with it may call home.

    A cell is bounded by a plane towards each other cell; a row further than ``reach`` from the wrong
    side of any of them has no link there.
    """
    near = x @ c.T
    own = near.argmax(axis=1)
    apart = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (c @ c.T)))
    gap = near[np.arange(len(x)), own][:, None] - near
    row, cell = np.nonzero(gap <= reach * apart[own] + 1e-9)
    keep = np.ones(len(row), bool)
    for at in range(0, len(row), 4096):
        i, j = row[at : at + 4096], cell[at : at + 4096]
        keep[at : at + 4096] = (near[i] - near[i, j][:, None] <= reach * apart[j] + 1e-9).all(axis=1)
    row, cell = row[keep], cell[keep]
    return row, cell, cell == own[row]


def _in_parts(x: np.ndarray, cells: Cells, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Placements in the parts of the cells."""
    row, cell, home = placements(x, cells.centroids, reach)
    out = []
    for j in np.unique(cell):
        at = np.flatnonzero(cell == j)
        if cells.parts[j] is None:
            out.append((row[at], np.full(len(at), j * MOST_PARTS), home[at]))
        else:
            r, part, own = placements(x[row[at]], cells.parts[j], reach)
            out.append((row[at][r], j * MOST_PARTS + part, own & home[at][r]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _placed(classes: DataFrame, cells: dict[tuple[int, int], Cells], threshold: float) -> DataFrame:
    """Each class in its home cell and where it is a guest."""
    if not cells:
        return classes.select("rep", "label", "dim", "copies", "v", F.lit(0).alias("cell"), F.lit(True).alias("home"))
    shared = classes.sparkSession.sparkContext.broadcast(cells)
    reach = float(np.sqrt(1 - threshold**2)) + 1e-9

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, STRIP):
                batch = whole.slice(first, STRIP)
                names = batch.schema.names
                label, dim = (batch.column(names.index(c)).to_numpy(zero_copy_only=False) for c in ("label", "dim"))
                vectors = batch.column(names.index("v"))
                for key in sorted(set(zip(label.tolist(), dim.tolist(), strict=True))):
                    at = np.flatnonzero((label == key[0]) & (dim == key[1]))
                    known = shared.value.get(key)
                    if known is None:
                        row, cell, home = np.arange(len(at)), np.zeros(len(at), int), np.ones(len(at), bool)
                    else:
                        row, cell, home = _in_parts(unit(_matrix(vectors.take(pa.array(at)), len(at))), known, reach)
                    for k in range(0, len(row), 4 * STRIP):
                        part = slice(k, k + 4 * STRIP)
                        rows = batch.take(pa.array(at[row[part]]))
                        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(cell[part], pa.int32()), pa.array(home[part], pa.bool_())], names=[*names, "cell", "home"])

    rows = classes.select("rep", "label", "dim", "copies", "v")
    return walk(rows, run, StructType([*rows.schema.fields, StructField("cell", IntegerType()), StructField("home", BooleanType())]))


class _Forest:
    """Grows a spanning forest of links that come in strips."""

    def __init__(self, reps: np.ndarray) -> None:
        self.reps, self.tree, self.edges = reps, np.arange(len(reps)), []

    def add(self, row: int, linked: np.ndarray) -> None:
        trees, first = np.unique(self.tree[linked], return_index=True)
        other = trees != self.tree[row]
        if other.any():
            self.edges += [(int(self.reps[row]), int(self.reps[linked[k]])) for k in first[other]]
            self.tree[np.isin(self.tree, trees[other])] = self.tree[row]


def _block_links(threshold: float):
    """Links between the home rows of either block and all rows of the other; of one block, of its rows."""

    def run(table: pa.Table) -> pa.Table:
        reps, copies = table.column("rep").to_numpy(), table.column("copies").to_numpy()
        home, block = table.column("home").to_numpy(zero_copy_only=False), table.column("block").to_numpy()
        x = unit(_matrix(table.column("v"), len(reps)))
        links, grown = np.zeros(len(reps), np.int64), _Forest(reps)
        sides = np.unique(block)
        alone = len(sides) == 1
        for side in sides:
            mine, other = np.flatnonzero(home & (block == side)), np.flatnonzero(block == side) if alone else np.flatnonzero(block != side)
            far = x[other].T
            for k in range(0, len(mine), STRIP):
                rows = mine[k : k + STRIP]
                hit = x[rows] @ far >= threshold
                hit &= reps[rows][:, None] != reps[other][None, :]
                links[rows] += hit @ copies[other]
                for r in np.flatnonzero(hit.any(axis=1)):
                    grown.add(rows[r], other[hit[r]])
        has = np.flatnonzero(links)
        return pa.table(
            {
                "a": pa.array([*reps[has].tolist(), *(a for a, _ in grown.edges)], pa.int64()),
                "b": pa.array([None] * len(has) + [b for _, b in grown.edges], pa.int64()),
                "n": pa.array([*links[has].tolist(), *[0] * len(grown.edges)], pa.int64()),
            }
        )

    return run


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES, cell: int = CELL, most_cells: int = MOST_CELLS) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    kind = "array<float>" if rows.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    wanted = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast(kind).alias("v"))
    wanted = wanted.withColumn("fine", F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    usable = valid(wanted.filter("fine"), "v", "label").withColumn("key", F.transform("v", lambda x: x + F.lit(0.0).cast(kind[6:-1])))
    classes = usable.groupBy("label", F.col("key").alias("v")).agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")).withColumn("dim", F.size("v"))
    classes = materialise(classes, "vectors")
    placed = materialise(_placed(classes, fit_cells(classes, cell=cell, most_cells=most_cells), threshold), "cells")
    key = ["label", "dim", "cell"]
    shape = placed.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) * F.col("dim") * 8 / block_bytes).cast("long").alias("blocks"))
    cut = placed.join(materialise(shape, "cell-shapes"), key).withColumn("block", F.pmod(F.xxhash64("rep"), "blocks"))
    # a row goes to each pair of blocks that its own is in, once
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cut = cut.select(*key, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "rep", "copies", "v", "home", "block")
    found = materialise(cut.groupBy(*key, "i", "j").applyInArrow(_block_links(threshold), "a long, b long, n long"), "vector-links")
    counts = found.filter("b is null").groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "rep")
    members = usable.select("vec_id", "label", F.col("key").alias("v")).join(classes.select("label", "v", "rep", "copies"), ["label", "v"]).select("vec_id", "rep", "copies")
    members = materialise(members, "members")
    twice = members.groupBy("vec_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low < high")
    twice = members.join(twice, "vec_id").select(F.col("rep").alias("a"), F.col("low").alias("b"))
    component = connected_components(found.filter("b is not null").select("a", "b").unionByName(twice)).withColumnRenamed("node", "rep")
    known = members.join(counts, "rep", "left").join(component, "rep", "left")
    known = known.groupBy("vec_id").agg(F.sum(F.coalesce("n", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), F.min(F.coalesce("component", "rep")).alias("component_id"))
    out = wanted.select("vec_id").join(known, "vec_id", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))
    )
