"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Tokens are runs of letters, of digits or of symbols, A-Z lower-cased; features are hashed 1- and 2-grams (and how
often 2-grams repeat), counted and scaled to length 1. A document's score is one sparse dot product.

Labels are read from a sample of at most SAMPLE labelled rows outside the held-out fold, chosen by a hash of the id.
Features are made where the texts lie; one task streams the sample's features through the learner, in hash order.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, slices, table

SLOTS, SAMPLE, FOLDS, KEEP_FROM = 1 << 18, 10_000, 5, 0.3
# ALPHA and PASSES: the least loss on fold 4 after training on folds 1 to 3; the held-out fold 0 had no part in it.
ALPHA, BETA, L1, L2, PASSES = 4.0, 1.0, 0.01, 0.01, 6


class Features:
    """Text to (slots, values). Remembers hashes of tokens, up to a fixed number."""

    def __init__(self, slots: int = SLOTS, remembered: int = 200_000):
        import re

        self.find = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+").findall
        self.slots, self.remembered, self.known = slots, remembered, {}

    def __call__(self, text: str | None):
        from zlib import crc32

        known = self.known
        if len(known) > self.remembered:
            known.clear()
        hashes = []
        for t in self.find(text or ""):
            h = known.get(t)
            if h is None:
                h = known[t] = crc32(t.lower().encode("utf-8", "surrogatepass"))
            hashes.append(h)
        one = np.array(hashes, np.uint64)
        two = (one[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ one[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) if len(one) > 1 else one[:0]
        seen, times = np.unique(two, return_counts=True)
        bucket = np.minimum(np.log2(times).astype(np.uint64), np.uint64(15))
        often = np.repeat(bucket + np.uint64(0xABCDEF01), times)  # one feature for all 2-grams that repeat as often
        every = np.concatenate([one * np.uint64(0xFF51AFD7ED558CCD), two, often * np.uint64(0xD6E8FEB86659FD93)])
        every ^= every >> np.uint64(29)
        slots, counts = np.unique((every * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(40), return_counts=True)
        slots, back = np.unique(slots % np.uint64(self.slots), return_inverse=True)
        values = np.bincount(back, counts, len(slots)) if len(slots) else np.zeros(0)
        return slots.astype(np.int32), (values / (np.sqrt(values @ values) or 1)).astype(np.float32)


class Leader:
    """FTRL-Proximal for logistic loss; the last weight is the bias."""

    def __init__(self, slots: int = SLOTS):
        self.z, self.n = np.zeros(slots + 1), np.zeros(slots + 1)

    def weights(self, at=slice(None)):
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def learn(self, slots, values, label: int) -> None:
        at, x = np.append(slots, len(self.z) - 1), np.append(values, 1.0)
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - label) * x
        self.z[at] += g - (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA * w
        self.n[at] += g * g


def labelled(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, y, at: at most `sample` labelled ids of the training folds. Null labels and ids are left out; of
    different labels of one id the least counts."""
    rows = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold(FOLDS) != 0))
    rows = rows.groupBy("doc_id").agg(F.min("quality").cast("int").alias("y"))
    return rows.withColumn("at", F.xxhash64("doc_id")).orderBy("at", "doc_id").limit(sample)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, passes: int = PASSES) -> np.ndarray:
    """SLOTS weights and a bias; all zero without labels. Rows that share a labelled id are all learnt from."""
    chosen = docs.select("doc_id", "text").join(F.broadcast(labelled(labels, sample)), "doc_id")  # `sample` ids at most

    def featured(batches):
        import pyarrow as pa

        make = Features()
        for b in (x for big in batches for x in slices(big)):
            got = [make(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("at"), b.column("y"), pa.array([s.tobytes() for s, _ in got], pa.binary()), pa.array([v.tobytes() for _, v in got], pa.binary())], ["at", "y", "slots", "values"])

    def learnt(batches):
        import pyarrow as pa

        leader, rows = Leader(), []
        for b in batches:
            for y, s, v in zip(b.column("y").to_pylist(), b.column("slots").to_pylist(), b.column("values").to_pylist(), strict=True):
                rows.append((np.frombuffer(s, np.int32), np.frombuffer(v, np.float32), int(y > 0)))
                leader.learn(*rows[-1])
        for _ in range(passes - 1):
            for row in rows:
                leader.learn(*row)
        yield pa.RecordBatch.from_arrays([pa.array([leader.weights().astype(np.float32).tobytes()], pa.binary())], ["weights"])

    rows = chosen.select("at", "y", "text").mapInArrow(featured, "at long, y int, slots binary, values binary")
    model = rows.repartition(1).sortWithinPartitions("at", "slots", "values").mapInArrow(learnt, "weights binary").first()
    return np.frombuffer(model["weights"], np.float32) if model else np.zeros(SLOTS + 1, np.float32)


def scored(df: DataFrame, weights: np.ndarray) -> DataFrame:
    """df with `score` (0 to 1, likelier good) and `predicted`; columns of these names are replaced. Null texts count
    as empty; an empty text scores by the bias alone."""
    df = df.drop("score", "predicted")
    told = df.sparkSession.sparkContext.broadcast(weights)  # SLOTS + 1 floats

    def score(batches):
        import pyarrow as pa

        make, w = Features(), told.value.astype(np.float64)
        for b in (x for big in batches for x in slices(big)):
            got = [w[s] @ v + w[-1] for s, v in map(make, b.column("text").to_pylist())]
            p = 1 / (1 + np.exp(-np.clip(np.array(got, float), -500, 500)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p), pa.array((p >= KEEP_FROM).astype(np.int32))], [*b.schema.names, "score", "predicted"])

    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return df.mapInArrow(score, schema)


def op5_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = train(docs, table(spark, sf_dir, "labels"))
    rows = docs.select("doc_id", "text", (fold(FOLDS) == 0).alias("held_out"))
    return scored(rows, weights).drop("text")


QUERIES = {"op5_quality": op5_quality}
SQL: dict[str, str] = {}
