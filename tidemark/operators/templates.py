"""Template mining by a fixed-depth tree, and the template dimension.

The tree parts token lists by service, by length and by their first token; at a leaf a list joins the most similar of the
templates there.  Which first tokens have a leaf of their own depends on the first sight of each alone, so leaves are
known before any list is placed, and each of them is mined by itself: its lists stream through a task in the order of
first sight, and the task keeps the leaf's templates only.  The result is that of one tree over a service's texts in
order, whatever the partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored

# Depth of the tree (service and length, first token, templates), least similarity, children of a node.
DEPTH, SIMILARITY, MAX_CHILDREN, WILD = 4, 0.6, 100, "<*>"


class Leaf:
    """The templates of token lists of one length.

    A list that is similar enough joins a template, which keeps the tokens that they share; else it begins one.  One that
    joins differs at few places, so if the places are dealt into one block more than that, some block of it is equal to
    the template's: only templates that began with such a block are compared, and all that can be joined are among them.
    """

    def __init__(self, similarity: float = SIMILARITY):
        self.similarity, self.held = similarity, 0
        self.codes: dict[str, int] = {}
        self.rows: np.ndarray | None = None
        self.blocks: list[tuple[int, int]] | None = None
        self.begun: dict[tuple[int, ...], int | list[int]] = {}

    @property
    def templates(self) -> list[list[str]]:
        words = [*self.codes, WILD]  # the wildcard is -1, the last of them
        return [[words[c] for c in row] for row in self.rows[: self.held].tolist()] if self.held else []

    def _start(self, length: int) -> None:
        self.rows = np.empty((16, length), np.int32)
        need = next((n for n in range(length + 1) if n / max(length, 1) >= self.similarity), length + 1)
        # where no token need be shared, all templates are compared; where none can be enough, none
        n = length - need + 1
        self.blocks = None if need == 0 else [(length * i // n, length * (i + 1) // n) for i in range(n)]

    def _near(self, own: list[int]) -> list[int]:
        if self.blocks is None:
            return [*range(self.held)]
        found = set()
        for a, b in self.blocks:
            # a wildcard is equal to nothing
            at = self.begun.get((a, *own[a:b]))
            if at is not None:
                found.update((at,) if isinstance(at, int) else at)
        return [*found]

    def _begin(self, own: list[int]) -> None:
        if self.held == len(self.rows):
            self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
        self.rows[self.held] = own
        for a, b in self.blocks or ():
            if -1 not in own[a:b]:
                key = (a, *own[a:b])
                at = self.begun.setdefault(key, self.held)
                if isinstance(at, list):
                    at.append(self.held)
                elif at != self.held:
                    self.begun[key] = [at, self.held]
        self.held += 1

    def add(self, tokens: list[str]) -> int:
        """Which template the tokens join; of equally similar ones that with most wildcards, then the first."""
        codes = self.codes
        own = [-1 if t == WILD else codes.setdefault(t, len(codes)) for t in tokens]
        if self.rows is None:
            self._start(len(own))
        near = np.array(self._near(own), np.int64)
        if len(near):
            rows, row = self.rows[near], np.array(own, np.int32)
            same = ((rows == row) & (row != -1)).sum(axis=1)
            best = np.lexsort((near, -(rows == -1).sum(axis=1), -same))[0]
            if same[best] / max(len(own), 1) >= self.similarity:
                at = int(near[best])
                self.rows[at] = np.where(rows[best] == row, row, -1)
                return at
        self._begin(own)
        return self.held - 1


def mined(lines: DataFrame, room: int = MAX_CHILDREN) -> DataFrame:
    """service, text, template_id, template of the distinct texts of ``lines`` (service, text, first_seen).

    Ids number a service's templates by first sight.  A first token with a digit goes the wildcard's way, and so do those
    that a node has no room for when they are first seen.
    """
    tokens = F.filter(F.split("text", " "), lambda t: t != "")
    texts = lines.groupBy("service", "text").agg(F.min("first_seen").alias("first_seen"))
    first = F.coalesce(F.get(tokens, 0), F.lit(""))
    texts = texts.select("service", "text", "first_seen", F.size(tokens).alias("length"), F.when(F.rlike(first, F.lit(r"(?U)\d")), WILD).otherwise(first).alias("first"))
    # used for the leaves and for the lists that go to them
    texts = stored(texts, "texts")
    sights = texts.groupBy("service", "length", "first").agg(F.min(F.struct("first_seen", "text")).alias("sight"))
    early = F.row_number().over(Window.partitionBy("service", "length").orderBy("sight")) <= room
    leaves = sights.select("service", "length", "first", F.when(early, F.col("first")).otherwise(WILD).alias("leaf"))
    place = ["service", "length", "leaf"]
    placed = texts.join(leaves, ["service", "length", "first"]).select(*place, "first_seen", "text")

    columns = [*place, "local", "first_seen", "text", "template", "begins"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, leaf = None, Leaf()

        def ended() -> pd.DataFrame:
            own = [" ".join(t) for t in leaf.templates]
            return pd.DataFrame({"service": at[0], "length": at[1], "leaf": at[2], "local": range(len(own)), "first_seen": None, "text": None, "template": own, "begins": False})

        for frame in frames:
            out, full = [], []
            for key, part in frame.groupby(place, sort=False):
                if key != at:
                    if at:
                        full.append(ended())
                    at, leaf = key, Leaf()
                local = []
                begins = []
                for text in part["text"]:
                    before = leaf.held
                    local.append(leaf.add([t for t in text.split(" ") if t]))
                    begins.append(leaf.held > before)
                out.append(part[[*place, "first_seen", "text"]].assign(local=local, template=None, begins=begins))
            for made in (full, out):
                if made:
                    yield pd.concat(made)[columns]
        if at:
            yield ended()[columns]

    types = {f.name: f.dataType.simpleString() for f in placed.schema.fields}
    schema = f"service {types['service']}, length int, leaf string, local int, first_seen {types['first_seen']}, text string, template string, begins boolean"
    rows = stored(placed.repartition(*place).sortWithinPartitions(*place, "first_seen", "text").mapInPandas(run, schema), "mined")
    on = [*place, "local"]
    begun = rows.filter("begins").select(*on, "first_seen", F.col("text").alias("_begun"))
    number = F.row_number().over(Window.partitionBy("service").orderBy("first_seen", "_begun"))
    named = rows.filter("template IS NOT NULL").select(*on, "template").join(begun, on).withColumn("template_id", F.format_string("%s:T%05d", "service", number))
    return rows.filter("text IS NOT NULL").select(*on, "text").join(named.select(*on, "template_id", "template"), on).select("service", "text", "template_id", "template")
