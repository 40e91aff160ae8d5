"""Best-fit packing under conflicts: bins ordered by what room is left carry bitmaps of sources and copy clusters.

Pieces are placed by falling length. Successor search begins at the smallest room that fits and goes on to the next
until a bin has neither the piece's source nor its cluster of copies; that bin is the tightest compatible one.
Blocks of about BLOCK_ROWS documents, by hash, are packed on their own: a bin never spans two blocks, so blocks need
no exchange, a hot source spreads evenly, and each block loses a few partly filled bins at most.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

CAPACITY, BLOCK_ROWS = 8192, 2048
SCHEMA = "doc_id long, piece int, start long, length long, bin long, offset long"


def pack(lengths, sources, clusters, capacity=CAPACITY):
    """(document's position, piece, start, length, bin, offset) for each piece of each document of one block.

    A document longer than a bin is cut into pieces of a bin's length and a rest. Pieces of one document conflict
    with each other, as they share a source and a cluster. A null source or cluster is a value like any other.
    """
    bit = {}
    mask = [(1 << bit.setdefault((0, s), len(bit))) | (1 << bit.setdefault((1, c), len(bit))) for s, c in zip(sources, clusters, strict=True)]
    out, pieces, bins = [], [], 0
    for i, n in enumerate(lengths):
        whole = n // capacity if n else 0
        for k in range(whole):  # fills a bin
            out.append((i, k, k * capacity, capacity, bins, 0))
            bins += 1
        if n - whole * capacity or not n:
            pieces.append((-(n - whole * capacity), i, whole))
    pieces.sort()
    room = []  # (what is left, bin), ascending
    held = {}
    for n, i, k in pieces:
        n = -n
        at = bisect_left(room, (n, -1))
        while at < len(room) and held[room[at][1]] & mask[i]:
            at += 1
        if at < len(room):
            left, b = room.pop(at)
        else:
            left, b = capacity, bins
            bins += 1
            held[b] = 0
        held[b] |= mask[i]
        out.append((i, k, k * capacity, n, b, capacity - left))
        insort(room, (left - n, b))
    return out


def packed(df: DataFrame, doc_id="doc_id", length="length", source="source", cluster="cluster", capacity: int = CAPACITY, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Where each piece of each row goes: doc_id, piece, start, length, bin, offset. Every row has a piece.

    Null lengths count as 0; a row of length 0 has one empty piece. Rows that share a doc_id are separate documents
    (they share a cluster, if their texts are equal, and so never a bin). Other columns are ignored. The order of
    equal lengths is by doc_id, cluster and source, so the result doesn't depend on partitioning.
    """
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(length), F.lit(0)).cast("long").alias("length"), F.col(source).cast("string").alias("source"), F.col(cluster).cast("string").alias("cluster"))
    blocks = max(1, -(-rows.count() // block_rows))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "cluster"), F.lit(blocks)))

    def block(pdf):
        import pandas as pd

        ids = pdf["doc_id"].astype("Int64")
        pdf = pdf.assign(_id=ids).sort_values(["_id", "cluster", "source", "length"], na_position="first", kind="stable").reset_index(drop=True)
        clean = lambda c: [None if x is None or x != x else x for x in pdf[c]]
        got = pack([int(x) for x in pdf["length"]], clean("source"), clean("cluster"), capacity)
        out = pd.DataFrame(got, columns=["at", "piece", "start", "length", "bin", "offset"])
        out["bin"] += int(pdf["block"].iloc[0]) << 32
        out["doc_id"] = pdf["_id"].take(out["at"]).reset_index(drop=True)
        return out[["doc_id", "piece", "start", "length", "bin", "offset"]]

    return rows.groupBy("block").applyInPandas(block, SCHEMA)


def document_pieces(docs: DataFrame) -> DataFrame:
    """packed() over documents: length in code points, clusters of equal texts."""
    return packed(docs.select("doc_id", F.length("text").alias("length"), "source", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("cluster")))


def filled(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """The plan with each piece's text; for unique doc_id."""
    return plan.join(docs.select("doc_id", "text"), "doc_id", "left").withColumn("text", F.expr("substring(text, cast(start + 1 as int), cast(length as int))"))


def op3_packing(spark, sf_dir):
    return document_pieces(table(spark, sf_dir, "documents"))


QUERIES = {"op3_packing": op3_packing}
SQL: dict[str, str] = {}
