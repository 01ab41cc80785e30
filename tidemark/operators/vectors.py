"""A cell index for vector similarity: exact by bounds on angles, or approximate by the nearest cells alone.

A vector lies in the cell of its nearest centre; the centres are at most ``CELLS`` of the vectors themselves, those of the
least hashes.  A cell keeps its radius, the widest angle of a member from its centre, and its longest member.  A query at
angle a from a centre can't meet a member at less than a - radius, so cells whose bound stays below the similarity that is
wanted are left out, with no pair lost; or only the ``probes`` nearest cells are searched, at less cost and some recall.

What is left is compared in tiles: cells of a group that lie side by side make up slabs, so that a query is sent once to
all the cells of a slab that it searches; the members of a slab, and the queries that search it, are dealt into blocks by
a hash of their id, and each pair of blocks is a task's matrix product, made a strip at a time.  A group has about
``SPLIT`` blocks each way, of ``BLOCK`` to ``MOST`` rows, so that up to SPLIT x MOST members a row is sent to SPLIT tiles
at most and what is shuffled grows with the rows and not with the pairs; beyond that tiles stay bounded and it grows with
the pairs.  No group and no cell is one key, and of a tile only pairs that are similar enough, or a query's best, leave it.

Rows without a vector, and vectors of zeros, have no pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from ..sources.shared import stored

CELLS, BLOCK = 256, 512
#: Slabs of cells and blocks of queries of a whole table, the most rows of a block, and similarities of a strip.
SPLIT, MOST, STRIP = 16, 32_768, 1 << 22
#: Angles are wider by this much when they prune, against rounding.
SLACK = 1e-6


def _matrix(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    column = batch.column("embedding")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _chained(centres: np.ndarray) -> np.ndarray:
    """The centres, each followed by the nearest of those that are left."""
    if not len(centres):
        return centres
    left, order = set(range(1, len(centres))), [0]
    cos = centres @ centres.T
    while left:
        order.append(max(left, key=lambda i: cos[order[-1], i]))
        left.remove(order[-1])
    return centres[order]


def _width(rows: int) -> int:
    """Rows of a block where a table has so many."""
    return min(max(-(-rows // SPLIT), BLOCK), MOST)


def _present(rows: DataFrame) -> DataFrame:
    return rows.filter(F.exists("embedding", lambda x: x != 0) & ~F.exists("embedding", lambda x: x.isNull()))


class CellIndex:
    """The vectors of a table (keys, id, embedding) by cell; pairs are only sought among rows that agree on ``keys``.

    ``of`` names a column of the table of which ``best_of_each`` takes the best.
    """

    def __init__(self, rows: DataFrame, keys: list[str], cells: int = CELLS, of: str | None = None):
        self.keys, self.of = keys, of
        own = _present(rows).select(*keys, "id", "embedding", *([of] if of else []))
        # a bounded number of vectors, whatever the table
        chosen = [r.embedding for r in own.orderBy(F.xxhash64("id"), "id").select("embedding").limit(cells).collect()]
        self.centres = np.array(chosen, np.float64) if chosen else np.zeros((0, 1))
        self.centres = _chained(self.centres / np.linalg.norm(self.centres, axis=1, keepdims=True))
        centres = self.centres

        def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch)
                length = np.linalg.norm(x, axis=1)
                cos = np.clip((x / length[:, None]) @ centres.T, -1, 1) if len(x) else np.zeros((0, 1))
                cell = cos.argmax(axis=1) if len(x) else np.zeros(0, np.int64)
                angle = np.arccos(cos[np.arange(len(x)), cell])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(angle), pa.array(length)], names=[*batch.schema.names, "cell", "angle", "length"])

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields)
        self.rows = stored(own.mapInArrow(assigned, f"{fields}, cell int, angle double, length double"), "cells")
        self.sizes = stored(self.rows.groupBy(*keys, "cell").agg(F.count("*").alias("members")), "sizes")
        bounds = self.rows.groupBy("cell").agg(F.max("angle"), F.max("length"), F.count("*")).collect()  # a row for each cell
        self.radius, self.longest, members = np.full(len(centres), -np.inf), np.zeros(len(centres)), np.zeros(len(centres), np.int64)
        for cell, angle, length, n in bounds:
            self.radius[cell], self.longest[cell], members[cell] = angle + SLACK, length, n
        self.width = _width(int(members.sum()))
        #: the slab of each cell
        self.slabs = (np.cumsum(members) - members) // self.width

    def _asked(self, queries: DataFrame, least: float | None, probes: int | None) -> DataFrame:
        """keys, id, embedding and the cells that a query searches, a row for each query."""
        centres, radius, longest = self.centres, self.radius, self.longest

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch)
                length = np.linalg.norm(x, axis=1)
                angle = np.arccos(np.clip((x / length[:, None]) @ centres.T, -1, 1)) if len(x) and len(centres) else np.zeros((len(x), len(centres)))
                wanted = np.broadcast_to(radius > -np.inf, angle.shape).copy()
                if least is not None:
                    cos = np.cos(np.clip(angle - radius, 0, np.pi))
                    # at a negative cosine the shortest member would be the most similar: those cells stay
                    wanted &= (cos * longest * length[:, None] >= least - SLACK) | (cos < 0) & (least < 0)
                if probes is not None and angle.shape[1] > probes:
                    wanted &= angle <= np.partition(np.where(radius > -np.inf, angle, np.inf), probes - 1, axis=1)[:, probes - 1 : probes]
                cells = pa.array([np.flatnonzero(w).tolist() for w in wanted], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.columns, cells], names=[*batch.schema.names, "cells"])

        own = _present(queries).select(*self.keys, "id", "embedding")
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields)
        return own.mapInArrow(run, f"{fields}, cells array<int>")

    def searched(self, queries: DataFrame, least: float | None = None, probes: int | None = None) -> DataFrame:
        """keys, id, embedding and cell of each cell that a query searches."""
        found = self._asked(queries, least, probes)
        return found.select(*self.keys, "id", "embedding", F.explode("cells").alias("cell")).join(self.sizes, [*self.keys, "cell"])

    def _tiles(self, queries: DataFrame, least: float | None, probes: int | None) -> GroupedData:
        """Queries (which ask) and members by tile: a block of each of a slab of a group."""
        every_slab = F.array(*(F.lit(int(s)) for s in self.slabs))  # a number for each cell
        slabs = F.array_distinct(F.transform("cells", lambda c: F.get(every_slab, c)))
        asked = stored(self._asked(queries, least, probes).withColumn("slabs", slabs).drop("cells"), "searched")
        held = self.rows.withColumn("slab", F.get(every_slab, F.col("cell")))
        place = [*self.keys, "slab"]
        each = asked.select(*self.keys, "id", "embedding", F.explode("slabs").alias("slab"))
        members = held.groupBy(*place).agg(F.count("*").alias("members"))
        sizes = stored(each.groupBy(*place).agg(F.count("*").alias("queries")).join(members, place), "tiles")
        width = {"members": self.width, "queries": _width(asked.count())}
        blocks = lambda n: F.ceil(F.col(n) / width[n]).cast("int")
        own = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "id"), blocks(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
        of = [self.of] if self.of else []
        left = each.join(sizes, place).select(*place, "id", "embedding", *(F.lit(None).cast(self.rows.schema[c].dataType).alias(c) for c in of), F.lit(True).alias("asks"), own("queries", 1).alias("q"), every("members").alias("m"))
        right = held.join(sizes, place).select(*place, "id", "embedding", *of, F.lit(False).alias("asks"), own("members", 2).alias("m"), every("queries").alias("q"))
        return left.unionByName(right).groupBy(*place, "q", "m")

    def matches(self, queries: DataFrame, least: float | None = None, k: int | None = None, probes: int | None = None) -> DataFrame:
        """keys, id, other and sim of the pairs of similarity ``least`` or more, of each tile at most the ``k`` best of a query.

        With ``k`` a query's best are among the rows, but not alone: rank them.  A row is no match of itself.
        """

        def pairs(sim: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            if k is not None and sim.shape[1] > k:
                # ties at the k-th place stay
                kept &= sim >= np.partition(np.where(kept, sim, -np.inf), -k, axis=1)[:, -k][:, None] - 1e-9
            i, j = np.nonzero(kept)
            return i, j, sim[i, j]

        return self._compared(queries, least, probes, "id", "other", lambda held: (held, pairs))

    def best_of_each(self, queries: DataFrame, least: float | None = None) -> DataFrame:
        """keys, id, the column ``of`` and sim: of each tile the best similarity, ``least`` or more, of a query to each ``of``."""
        of = self.of

        def sorted_by_of(held: pa.Table):
            held = held.sort_by(of)
            values = held.column(of).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))

            def best(sim: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                top = np.maximum.reduceat(np.where(kept, sim, -np.inf), starts, axis=1)
                i, j = np.nonzero(top > -np.inf)
                return i, starts[j], top[i, j]

            return held, best

        return self._compared(queries, least, None, of, of, sorted_by_of)

    def _compared(self, queries: DataFrame, least: float | None, probes: int | None, column: str, name: str, prepared: Callable) -> DataFrame:
        """keys, id, ``column`` of members as ``name``, and sim of what the function that is ``prepared`` for the members picks of a strip."""
        keys, rows = self.keys, self.rows.schema

        def tile(table: pa.Table) -> pa.Table:
            asking = table.column("asks")
            asks, (held, picked) = table.filter(asking), prepared(table.filter(pc.invert(asking)))
            types = [*(table.schema.field(key).type for key in keys), table.schema.field("id").type, table.schema.field(column).type, pa.float64()]
            schema = pa.schema(list(zip([*keys, "id", name, "sim"], types, strict=True)))
            out = []
            if len(asks) and len(held):
                x, y = _matrix(asks), _matrix(held).T
                a, b = asks.column("id").to_numpy(), held.column("id").to_numpy()
                strip = max(1, STRIP // len(b))
                for start in range(0, len(a), strip):
                    sim = x[start : start + strip] @ y
                    kept = (a[start : start + strip, None] != b[None, :]) & (sim >= (-np.inf if least is None else least))
                    i, j, best = picked(sim, kept)
                    i, first = pa.array(i + start), pa.array(np.zeros(len(i), np.int64))
                    out.append(pa.Table.from_arrays([*(table.column(key).take(first) for key in keys), asks.column("id").take(i), held.column(column).take(pa.array(j)), pa.array(best, pa.float64())], schema=schema))
            return pa.concat_tables(out) if out else schema.empty_table()

        schema = ", ".join([*(f"`{key}` {rows[key].dataType.simpleString()}" for key in keys), f"id {rows['id'].dataType.simpleString()}", f"`{name}` {rows[column].dataType.simpleString()}", "sim double"])
        return self._tiles(queries, least, probes).applyInArrow(tile, schema)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact pairs (id, other) that were found."""
    both = exact.join(found.select("id", "other").distinct().withColumn("hit", F.lit(1)), ["id", "other"], "left")
    return both.agg(F.coalesce(F.avg(F.coalesce("hit", F.lit(0))), F.lit(1.0))).first()[0]
