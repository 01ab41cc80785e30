"""Similarity links between templates and documents, their layers, reconciliation, and clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored
from .vectors import CellIndex

# Similarities from which a link is inherited, and by how much a corpus link must lead.
INHERIT = {"ERROR": 0.85, "WARN": 0.88, "INFO": 0.92}
MARGIN = 0.05


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    """The vector at unit length; null for a vector of zeros."""
    length = F.sqrt(dot(v, v))
    return F.when(length > 0, F.transform(v, lambda x: x / length))


def by_class(cls: Column, thresholds: dict[str, float] = INHERIT) -> Column:
    out = F.lit(thresholds["INFO"])
    for name, value in thresholds.items():
        out = F.when(cls == name, value).otherwise(out)
    return out


def similar(left: DataFrame, right: DataFrame, keys: list[str], least: float | None = None, k: int | None = None) -> DataFrame:
    """left id, right id and sim of pairs that agree on ``keys``, of ``least`` or more; with ``k`` at least the ``k`` best of each id.

    Pairs are found through a cell index, exactly: what its bounds leave out is below ``least``.
    """
    return CellIndex(right, keys).matches(left, least, k)


def best_by_doc(left: DataFrame, doc_lines: DataFrame, keys: list[str], least: float | None = None) -> DataFrame:
    """keys, left id, doc and sim of the nearest line of each document, ``least`` or more; ``doc_lines``: keys, id, embedding, doc.

    Few pairs leave the comparison: only the best of a document in each tile.
    """
    best = CellIndex(doc_lines, keys, of="doc").best_of_each(left, least)
    return best.groupBy(*keys, "id", "doc").agg(F.max("sim").alias("sim"))


def nearest(pairs: DataFrame, k: int = 1) -> DataFrame:
    """The ``k`` most similar others of each id; the least other at a tie."""
    order = Window.partitionBy("id").orderBy(F.desc("sim"), "other")
    return pairs.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= k)


def inherited(templates: DataFrame) -> DataFrame:
    """Layer 1: each undecided template takes the document of the nearest manual one of its service and class."""
    pairs = similar(templates.filter("NOT manual"), templates.filter("manual"), ["service", "class"], min(INHERIT.values()), 1)
    return nearest(pairs).filter(F.col("sim") >= by_class(F.col("class"))).select("id", F.col("other").alias("doc"), "sim")


def corpus(templates: DataFrame, doc_lines: DataFrame, thresholds: dict[str, float], margin: float = MARGIN) -> DataFrame:
    """Layer 2: the document with the nearest line of the template's class, if no other document comes near.

    ``doc_lines``: doc, class, id, embedding.
    """
    # a second document matters if it comes within the margin of a link
    per = best_by_doc(templates.filter("NOT manual"), doc_lines, ["class"], min(thresholds.values()) - margin - 1e-9)
    order = Window.partitionBy("id").orderBy(F.desc("sim"), "doc")
    ranked = per.withColumn("rn", F.row_number().over(order)).withColumn("second", F.lead("sim").over(order))
    close = (F.col("rn") == 1) & (F.col("sim") >= by_class(F.col("class"), thresholds)) & (F.col("sim") - F.coalesce("second", F.lit(-1.0)) >= margin)
    return ranked.filter(close).select("id", "doc", "sim")


def reconciled(desired: DataFrame, current: DataFrame) -> DataFrame:
    """Actions that make ``current`` (id, doc, source, sim) what is ``desired``; manual and rejected links stay."""
    both = desired.withColumnsRenamed({"doc": "new_doc", "source": "new_source", "sim": "new_sim"}).join(current, "id", "full")
    fixed = F.col("source").isin("manual", "rejected")
    same = F.col("doc").eqNullSafe(F.col("new_doc")) & F.col("source").eqNullSafe(F.col("new_source")) & (F.abs(F.col("sim") - F.col("new_sim")) < 1e-4)
    action = F.when(fixed, "keep").when(F.col("new_doc").isNull(), F.when(F.col("source").isin("inherited", "corpus"), "delete").otherwise("keep")).when(F.col("doc").isNull(), "insert").when(same, "keep").otherwise("update")
    return both.select("id", action.alias("action"), F.coalesce(F.when(fixed, F.col("doc")), F.col("new_doc"), F.col("doc")).alias("doc"))


def edges(templates: DataFrame, least: float) -> DataFrame:
    """Pairs a < b of a service at or above a similarity."""
    pairs = similar(templates, templates, ["service"], least).filter(F.col("id") < F.col("other"))
    return pairs.select("service", F.col("id").alias("a"), F.col("other").alias("b"), "sim")


def clusters(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """id and cluster (the least id that links reach).

    Each round, a node takes the least label around it and then that label's own label, so that labels travel twice as
    far each round.  Each round is written, which cuts the lineage; a chain of n takes some log2(n) rounds.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = stored(both, "edges")
    labels = nodes.select("id", F.col("id").alias("cluster"))
    moved = 1
    while moved:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("cluster").alias("least"))
        taken = labels.join(near, labels["id"] == near["a"], "left").select("id", F.least("cluster", "least").alias("next"), "cluster")
        jumps = taken.select(F.col("id").alias("via"), F.col("next").alias("further"))
        new = stored(taken.join(jumps, taken["next"] == jumps["via"], "left").select("id", F.least("next", "further").alias("next"), "cluster"), "labels")
        moved = new.filter("next <> cluster").limit(1).count()
        labels = new.select("id", F.col("next").alias("cluster"))
    return labels


def evaluation(pairs: DataFrame, truth: DataFrame, thresholds: list[float], margins: list[float]) -> DataFrame:
    """right, wrong and none over a grid of thresholds and margins, each id against all others."""
    order = Window.partitionBy("id").orderBy(F.desc("sim"), "doc")
    best = pairs.groupBy("id", "doc").agg(F.max("sim").alias("sim")).withColumn("rn", F.row_number().over(order)).withColumn("second", F.lead("sim").over(order)).filter("rn = 1").join(truth, "id")
    grid = F.explode(F.array(*(F.struct(F.lit(t).alias("threshold"), F.lit(m).alias("margin")) for t in thresholds for m in margins)))
    rows = best.withColumn("g", grid)
    chosen = (F.col("sim") >= F.col("g.threshold")) & (F.col("sim") - F.coalesce("second", F.lit(-1.0)) >= F.col("g.margin"))
    return rows.groupBy("g.threshold", "g.margin").agg(F.count_if(chosen & (F.col("doc") == F.col("truth"))).alias("right"), F.count_if(chosen & (F.col("doc") != F.col("truth"))).alias("wrong"), F.count_if(~chosen).alias("none"))
