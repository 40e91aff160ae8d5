import zlib

import numpy as np
from helpers import SF, docs, folder, texts
from pyspark.sql import functions as F

from menurank.llm import quality


def test_held_out_accuracy(spark):
    sf = SF.replace("0.001", "0.01")
    rows = quality.op5_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out")
    got = rows.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")).alias("a"), F.avg(((F.col("predicted") == 0) & (F.col("quality") == 1)).cast("int")).alias("lost")).first()
    assert got["a"] > 0.95 and got["lost"] < 0.02


def test_hard_rows(spark, tmp_path):
    labels = [(1, 1, 0), (1, 0, 0), (2, None, 0), (None, 1, 0), (6, 0, None), (7, 1, 0), (99, 1, 1)]
    got = quality.op5_quality(spark, folder(spark, tmp_path, labels=labels)).collect()
    assert len(got) == len(texts()) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode() if r["doc_id"] is not None else b"") % 5 == 0) for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (3, 4, 5)}) == 1
    out = quality.scored(docs(spark), np.zeros(quality.SLOTS + 1, np.float32))
    assert out.columns.count("score") == 1 and {r["score"] for r in out.collect()} == {0.5}


def test_without_labels_or_rows(spark, tmp_path):
    assert {r["predicted"] for r in quality.op5_quality(spark, folder(spark, tmp_path / "a")).collect()} == {1}
    assert quality.op5_quality(spark, folder(spark, tmp_path / "b", [], [(1, 1, 0)])).count() == 0


def test_labels_are_a_bounded_sample_of_the_training_folds(spark):
    labels = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    got = quality.labelled(labels, 100).collect()
    assert len(got) == 100 and all(zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in got)


def test_scores_do_not_see_other_columns(spark):
    w = np.random.default_rng(1).normal(size=quality.SLOTS + 1).astype(np.float32)
    rows = docs(spark, extra=False)
    changed = rows.withColumn("doc_id", F.lit(5)).withColumn("source", F.lit("z")).withColumn("lang", F.lit("z"))
    assert sorted(r["score"] for r in quality.scored(rows, w).collect()) == sorted(r["score"] for r in quality.scored(changed, w).collect())


def plain_features(text):
    """Counts by slot, with Python's own numbers."""
    import math
    import re

    m, tokens = 2**64, re.findall(r"[^\W\d_]+|\d+|[^\w\s]+|_+", text or "")
    one = [zlib.crc32(t.lower().encode()) for t in tokens]
    two = [(a * 0x9E3779B97F4A7C15 % m) ^ (b * 0xC2B2AE3D27D4EB4F % m) for a, b in zip(one, one[1:])]
    often = [(min(15, int(math.log2(two.count(x)))) + 0xABCDEF01) * 0xD6E8FEB86659FD93 % m for x in two]
    out = {}
    for x in [o * 0xFF51AFD7ED558CCD % m for o in one] + two + often:
        slot = ((x ^ (x >> 29)) * 0xBF58476D1CE4E5B9 % m >> 40) % quality.SLOTS
        out[slot] = out.get(slot, 0) + 1
    length = math.sqrt(sum(v * v for v in out.values())) or 1
    return {s: v / length for s, v in out.items()}


def test_scores_like_plain_follow_the_regularised_leader(spark, tmp_path):
    import math

    labels = [(1, 1, 0), (6, 0, 0), (7, 0, 0), (9, 1, 0), (11, 0, 1), (12, 1, 0), (2, 1, 0), (4, 0, 0)]
    got = {(r["doc_id"], r["score"]) for r in quality.op5_quality(spark, folder(spark, tmp_path, labels=labels)).collect()}
    learnt = quality.labelled(spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    known = {r["doc_id"]: (r["at"], r["y"]) for r in learnt}
    made = lambda t: sorted(plain_features(t).items())
    rows = [(known[i][0], np.array([s for s, _ in made(t)], np.int32).tobytes(), made(t), known[i][1]) for i, t in texts() if i in known]
    z, n = {}, {}

    def weight(s):
        if abs(z.get(s, 0)) <= quality.L1:
            return 0.0
        return -(z[s] - math.copysign(quality.L1, z[s])) / ((quality.BETA + math.sqrt(n[s])) / quality.ALPHA + quality.L2)

    p = lambda x: 1 / (1 + math.exp(-sum(weight(s) * v for s, v in x)))
    for _ in range(quality.PASSES):
        for _, _, x, y in sorted(rows, key=lambda r: r[:2]):
            x = [*x, ("bias", 1.0)]
            g = p(x) - y
            for s, v, w in [(s, v, weight(s)) for s, v in x]:
                z[s] = z.get(s, 0) + g * v - (math.sqrt(n.get(s, 0) + (g * v) ** 2) - math.sqrt(n.get(s, 0))) / quality.ALPHA * w
                n[s] = n.get(s, 0) + (g * v) ** 2
    assert sum(w != 0 for w in map(weight, z)) > 20
    assert len(got) >= 10 and all(any(abs(s - p([*made(t), ("bias", 1.0)])) < 2e-4 for j, t in texts() if j == i) for i, s in got)
