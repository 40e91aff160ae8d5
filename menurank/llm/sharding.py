"""Sharding: a uniform shuffle with exact shard sizes, by a hypergeometric communication matrix.

Each input block's rows are permuted locally, the matrix says how many of them go to each shard, the rows are
exchanged, and each shard is permuted again. Given multivariate hypergeometric counts this is a uniform permutation of
all rows, though no task ever holds a shard or the table.

Only DataFrame functions touch rows. The driver sees one count for each block (BLOCK_ROWS rows or more) and draws the
matrix down a tree: all blocks' share of each shard is halved again and again, each halving with a generator of its own.
"""

from __future__ import annotations

import math
import random
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored, table

SHARDS, BLOCK_ROWS, SEED = 24, 250_000, 20240613
BROADCAST_BLOCKS = 50_000  # 13 MB; only the plan depends on it


def shard_sizes(rows: int, shards: int) -> list[int]:
    """Counts that differ by one at most; the first shards take the rest."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def law(good: int, bad: int, drawn: int) -> tuple[int, np.ndarray]:
    """The least likely enough number of good ones among `drawn`, and probabilities from it on; they add up to 1. Numbers
    13 deviations and more from the mode, whose mass is far below what a double can tell from 0, are left out."""
    low, high, n = max(0, drawn - bad), min(good, drawn), good + bad
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (n + 2)))
    spread = math.sqrt(drawn / n * (good / n) * bad * ((n - drawn) / max(1, n - 1)))
    reach = int(13 * spread) + 64
    first, last = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(first, last, dtype=float)  # steps from k to k + 1
    steps = np.log(good - k) + np.log(drawn - k) - np.log(k + 1) - np.log(bad - drawn + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    weights = np.exp(logs - logs[mode - first])
    return first, weights / weights.sum()


def hypergeometric(rng: random.Random, good: int, bad: int, drawn: int) -> int:
    """A hypergeometric variate, by inversion of its normalised law."""
    low, high = max(0, drawn - bad), min(good, drawn)
    if low == high:
        return low
    first, p = law(good, bad, drawn)
    return first + min(len(p) - 1, int(np.searchsorted(np.cumsum(p), rng.random(), "right")))


def communication_matrix(block_rows: list[int], sizes: list[int], seed: int = SEED) -> list[list[int]]:
    """Rows each block sends to each shard: row sums are block_rows, column sums are sizes, drawn without bias."""
    upto, out = [0, *accumulate(block_rows)], [[0] * len(sizes) for _ in block_rows]
    nodes = [(0, len(block_rows), list(sizes))] if block_rows else []
    while nodes:
        lo, hi, held = nodes.pop()
        if hi - lo == 1:
            out[lo] = held
            continue
        mid, rng = (lo + hi) // 2, random.Random(f"{seed} {lo} {hi}")
        left, open_, share = upto[mid] - upto[lo], sum(held), []
        for size in held:
            open_ -= size
            share.append(hypergeometric(rng, size, open_, left))
            left -= share[-1]
        nodes += [(lo, mid, share), (mid, hi, [h - x for h, x in zip(held, share)])]
    return out


def hypergeometric_shards(df: DataFrame, shards: int = SHARDS, block_rows: int = BLOCK_ROWS, seed: int = SEED) -> DataFrame:
    """df (narrow columns) with `shard` and `slot` added; every row is kept.

    Block of a row: a hash of its columns, so a hot or null key or repeated rows spread by their other columns;
    wholly equal rows share a block, where any order of them is the same. Shard sizes differ by one at most; slots
    run from 0 without gaps in each shard. An empty table gives an empty table. Clashing columns `shard` and `slot`
    are replaced; others keep their names. Small tables have at least a block for 500 rows, up to 64.
    """
    df = df.drop("shard", "slot")
    total, key = df.count(), F.col("row")
    blocks = max(1, -(-total // block_rows), min(64, total // 500))
    rows = df.select(F.struct(*df.columns).alias("row"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), key), F.lit(blocks)).cast("int")).withColumn("r", F.xxhash64(F.lit(seed + 1), key))
    counts = {r["block"]: r["count"] for r in rows.groupBy("block").count().collect()}  # one row a block
    matrix = communication_matrix([counts.get(b, 0) for b in range(blocks)], shard_sizes(total, shards), seed)
    few = F.broadcast if blocks <= BROADCAST_BLOCKS else lambda frame: frame
    plan = df.sparkSession.createDataFrame([(b, list(accumulate(row))) for b, row in enumerate(matrix)], "block int, ends array<bigint>")
    placed = (
        rows.withColumn("i", F.row_number().over(W.partitionBy("block").orderBy("r", "row")) - 1)
        .join(few(plan), "block")
        .withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("i"))))
        .select("row", "shard", F.xxhash64(F.lit(seed + 2), key).alias("r"))
    )
    # The second permutation orders a shard by r. It is dealt out by leading bits of r, whose counts give offsets.
    fine = max(1, blocks * 2 // shards)
    piece = F.floor((F.shiftrightunsigned("r", 1).cast("double") / F.lit(2.0**63)) * fine).cast("int")
    placed = stored(placed.withColumn("piece", F.least(piece, F.lit(fine - 1))))
    sums = W.partitionBy("shard").orderBy("piece").rowsBetween(W.unboundedPreceding, W.currentRow)
    offsets = placed.groupBy("shard", "piece").agg(F.count("*").alias("n")).select("shard", "piece", (F.sum("n").over(sums) - F.col("n")).alias("offset"))
    again = W.partitionBy("shard", "piece").orderBy(F.shiftrightunsigned("r", 1), "r", "row")
    numbered = placed.withColumn("i", F.row_number().over(again) - 1).join(few(offsets), ["shard", "piece"])
    return numbered.select("row.*", "shard", (F.col("offset") + F.col("i")).alias("slot"))


def op8_sharding(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    narrow = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    out = hypergeometric_shards(narrow)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op8_sharding": op8_sharding}
SQL: dict[str, str] = {}
