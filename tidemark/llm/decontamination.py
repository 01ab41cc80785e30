"""Benchmark decontamination by winnowing: shared fingerprints are joined and their hits extended.

Words are runs of ASCII letters, lower-cased, digits and characters beyond ASCII.  Of each ``WIDTH`` runs of ``GRAM``
words in a row the leftmost of least hash is kept, in documents as in items, so that any ``GRAM + WIDTH - 1`` = ``WINDOW``
words which both have in a row leave one fingerprint at the same place of them in both.  A fingerprint carries the hashes
of the words that a window around it may hold.  Fingerprints are joined; a hit is extended to the left and the right while
the words agree, and counts if the words that agree are a window.  As every window shared has a fingerprint, the extended
hits cover exactly the words of shared windows.  Items of fewer words than a window are one window each: of those lengths
that occur, all runs of a document are looked up.

A filter of a bounded number of bits drops the runs that no item has before anything is shuffled; the join decides.  Equal
surroundings of items are joined once, whatever the number of items that have them.  Keys that many rows have are dealt
out.  Words agree if their 64-bit hashes do.

Defined results: a null or wordless text has no words and no hits, and a null or wordless item no windows; equal rows give
equal rows; null ids of documents are kept; an item without id marks words, but isn't counted or listed; rows of one
item_id are one item; very long texts are cut between words only to be hashed, and are whole for the windows; an empty
table gives an empty result, without items nothing is hit; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import materialize, slices, text_or_empty
from .words import dealt_join, filter_bits, gram_hashes, may_hold, word_hashes

GRAM, WIDTH = 5, 6
WINDOW = GRAM + WIDTH - 1
#: Words that a window may hold to the left of a fingerprint.
LEFT = WINDOW - GRAM

_HIT = "struct<fp: bigint, at: bigint, size: int, before: array<bigint>, after: array<bigint>>"
_ARROW = pa.list_(pa.struct([("fp", pa.int64()), ("at", pa.int64()), ("size", pa.int32()), ("before", pa.list_(pa.int64())), ("after", pa.list_(pa.int64()))]))


def winnowed(hashes: np.ndarray) -> np.ndarray:
    """Places of the hashes that are the leftmost least of some ``WIDTH`` in a row."""
    if len(hashes) < WIDTH:
        return np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(hashes, WIDTH)
    at = np.arange(len(views)) + views.argmin(axis=1)
    return at[np.concatenate([[True], at[1:] > at[:-1]])]


def fingerprints(codes: np.ndarray, lengths: tuple[int, ...], known: np.ndarray | None = None) -> list[dict]:
    """The fingerprints of a sequence of words that a filter may hold, and all runs of each of the short lengths.

    ``before`` holds the words to the left, nearest first, and ``after`` those from the fingerprint on.
    """
    out, signed = [], codes.view(np.int64)
    grams = gram_hashes(codes, GRAM)
    kept = winnowed(grams)
    for size, hashes, at in [(WINDOW, grams[kept], kept), *((n, h, np.arange(len(h))) for n in lengths for h in [gram_hashes(codes, n)])]:
        if known is not None:
            there = may_hold(known, hashes)
            hashes, at = hashes[there], at[there]
        left, right = (LEFT, WINDOW) if size == WINDOW else (0, size)
        for h, p in zip(hashes.view(np.int64).tolist(), at.tolist(), strict=True):
            out.append({"fp": h, "at": p, "size": size, "before": signed[max(0, p - left) : p][::-1].tolist(), "after": signed[p : p + right].tolist()})
    return out


def _scanned(docs: DataFrame, lengths: tuple[int, ...], known: np.ndarray) -> DataFrame:
    """row, doc_id, n_words and the fingerprints that some item may have, of each document; written, so that row is fixed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        for batch in slices(batches):
            n, hits = [], []
            for text in batch.column("text"):
                codes = word_hashes(text.as_py())
                n.append(len(codes))
                hits.append(fingerprints(codes, lengths, known))
            yield pa.RecordBatch.from_arrays([pa.array(range(row, row + len(n)), pa.int64()), batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(hits, _ARROW)], names=["row", "doc_id", "n_words", "hits"])
            row += len(n)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    return materialize(rows.mapInArrow(run, f"row bigint, doc_id bigint, n_words bigint, hits array<{_HIT}>"), "scanned")


def _item_windows(items: DataFrame) -> DataFrame:
    """item_id and the fingerprints with their surroundings of all items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hits = []
            for text in batch.column("text"):
                codes = word_hashes(text.as_py())
                short = (len(codes),) if 0 < len(codes) < WINDOW else ()
                hits.append(fingerprints(codes, short))
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(hits, _ARROW)], names=["item_id", "hits"])

    rows = items.select(F.col("item_id").cast("string").alias("item_id"), text_or_empty().alias("text"))
    found = rows.mapInArrow(run, f"item_id string, hits array<{_HIT}>").select("item_id", F.inline("hits")).drop("at")
    return materialize(found.withColumn("around", F.md5(F.concat_ws(",", "fp", "size", F.concat_ws(" ", F.col("before").cast("array<string>")), F.concat_ws(" ", F.col("after").cast("array<string>"))))), "items")


def _agreeing(a: str, b: str) -> Column:
    """How many values two arrays have in common from their start."""
    least = F.least(F.size(a), F.size(b))
    other = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), False)
    return F.when(other > 0, other - 1).otherwise(least)


def window_hits(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is shared, as three tables: documents (row, doc_id, n_words), hits (row, start, end, around), members (around, item_id).

    A hit is a run of words (end exclusive) that an item has too, by the item's surroundings of one fingerprint.
    """
    windows = _item_windows(items)
    lengths = tuple(sorted(r[0] for r in windows.filter(F.col("size") < WINDOW).select("size").distinct().collect()))  # nine at most
    scanned = _scanned(docs, lengths, filter_bits(windows.select("fp").distinct()))
    found = scanned.filter(F.size("hits") > 0).select("row", F.inline("hits"))
    sought = windows.select("fp", F.col("size").alias("window"), F.col("before").alias("left"), F.col("after").alias("right"), "around").distinct()
    pairs = dealt_join(found, sought, "fp", F.xxhash64("row", "at")).filter(F.col("size") == F.col("window"))
    extended = pairs.withColumn("back", _agreeing("before", "left")).withColumn("on", _agreeing("after", "right")).filter(F.col("back") + F.col("on") >= F.col("size"))
    hits = materialize(extended.select("row", (F.col("at") - F.col("back")).alias("start"), (F.col("at") + F.col("on")).alias("end"), "around"), "hits")
    return scanned, hits, windows.select("around", "item_id").distinct()


def _covered(spans: Column) -> Column:
    """How many words sorted spans cover."""
    zero = F.struct(F.lit(0).cast("bigint").alias("upto"), F.lit(0).cast("bigint").alias("n"))
    return F.aggregate(spans, zero, lambda a, s: F.struct(F.greatest(a["upto"], s["end"]).alias("upto"), (a["n"] + F.greatest(F.lit(0).cast("bigint"), s["end"] - F.greatest(a["upto"], s["start"]))).alias("n")))["n"]


def _items_of(hits: DataFrame, members: DataFrame) -> DataFrame:
    """row and item_id of each item that a document has a window of."""
    own = hits.select("row", "around").distinct()
    return dealt_join(own, members.filter(F.col("item_id").isNotNull()), "around", F.xxhash64("row")).select("row", "item_id").distinct()


def shared_spans(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, start and end (places of words, end exclusive) of the hits of each item in each document."""
    scanned, hits, members = window_hits(docs, items)
    named = dealt_join(hits, members, "around", F.xxhash64("row", "start")).select("row", "item_id", "start", "end").distinct()
    return named.join(scanned.select("row", "doc_id"), "row").drop("row")


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of each document."""
    scanned, hits, members = window_hits(docs, items)
    covered = hits.select("row", "start", "end").distinct().groupBy("row").agg(_covered(F.sort_array(F.collect_list(F.struct("start", "end")))).alias("n_hit"))
    named = _items_of(hits, members).groupBy("row").agg(F.count("*").alias("n_items"), F.sha2(F.concat_ws(",", F.sort_array(F.collect_list("item_id"))), 256).alias("items_sha256"))
    some = scanned.filter(F.size("hits") > 0).select("row", "doc_id", "n_words").join(covered, "row", "left").join(named, "row", "left")
    nothing = scanned.filter(F.size("hits") == 0).select("row", "doc_id", "n_words", F.lit(None).cast("bigint").alias("n_hit"), F.lit(None).cast("bigint").alias("n_items"), F.lit(None).cast("string").alias("items_sha256"))
    zero = F.lit(0).cast("bigint")
    return some.unionByName(nothing).select("doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.coalesce("n_hit", zero) > 0).alias("contaminated"))


#: DuckDB's form: windows as strings, by the lengths that items have.
ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') AS win
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
grams AS (SELECT row, p, n, array_to_string(w[p : p + n - 1], ' ') AS win
          FROM (SELECT row, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
hits AS (SELECT row, p, g.n, item_id FROM grams g JOIN windows USING (n, win)),
words AS (SELECT row, count(DISTINCT place) AS n_hit FROM (SELECT row, unnest(range(p, p + n)) AS place FROM hits) GROUP BY row),
named AS (SELECT row, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items FROM (SELECT DISTINCT row, item_id FROM hits WHERE item_id IS NOT NULL) GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(items, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (row) LEFT JOIN named USING (row)
"""
