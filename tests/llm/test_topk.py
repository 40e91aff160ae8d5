import math
import random

from helpers import same
from pyspark.sql import functions as F

from menurank.llm import topk
from menurank.llm.topk import top_k


def brute(rows, k, every):
    v = [(i, [math.floor(256 * c) for c in x]) for i, x in rows if i is not None and x is not None and all(c is not None and math.isfinite(c) for c in x)]
    out = []
    for i in {i for i, _ in v if i % every == 0}:
        scores = [(-sum(x * y for x, y in zip(a, b)), j) for q, a in v if q == i for j, b in v if j != i]
        out += [(i, r + 1, j, max(-(2**63), min(2**63 - 1, -s))) for r, (s, j) in enumerate(sorted(scores)[:k])]
    return out


def test_like_brute_force(spark):
    rng = random.Random(7)
    rows = [(i, [rng.choice([rng.gauss(0, 0.3), 0.0, 0.25]) for _ in range(12)]) for i in range(500)]
    rows += [(1000 + i, rows[i][1]) for i in range(60)] + [(None, [1.0] * 12), (3000, None), (3001, [None] + [0.0] * 11), (3050, [float("nan")] * 12), (3100, [float("inf")] * 12), (3150, [0.5] * 7), (3200, []), (10, [9.0] * 12), (10, [9.0] * 12), *([(77, [1.0] * 12)] * 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash")).withColumn("block", F.lit(1))
    got = [tuple(r) for r in top_k(df, 5, every=10, block_rows=50, query_rows=7).collect()]
    assert same(got, brute(rows, 5, 10))


def test_huge_values_and_small_tables(spark):
    rows = [(0, [1e30, -1.0]), (1, [1e15, 2.0]), (2, [-1e15, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in top_k(df).collect()}
    assert got == {(0, 1): 2**63 - 1, (0, 2): -(2**63)}
    assert top_k(df.limit(0)).count() == 0 and top_k(df.filter("vec_id = 0")).count() == 0


def test_stops_by_proof_before_all_postings_and_finds_the_same():
    """On the embeddings themselves; a floor known beforehand lets it stop sooner."""
    import duckdb
    import numpy as np

    v = np.floor(256 * np.array(duckdb.connect().execute("select embedding from '/root/testdata/sf0.1/embeddings.parquet' order by vec_id").fetchnumpy()["embedding"].tolist(), float))
    ids, index, known = np.arange(len(v)), topk.ImpactIndex(v), topk.ImpactIndex(v)
    for i in range(0, len(v), 50):
        scores = v @ v[i]
        scores[i] = -np.inf
        want = np.lexsort((ids, -scores))[:5]
        found, got = index.search(v[i], 5, ids, ids == i)
        assert (found == want).all() and (got == scores[want]).all()
        assert (known.search(v[i], 5, ids, ids == i, scores[want[-1]])[0] == want).all()
    assert known.read <= index.read < 0.8 * index.whole, (known.read / known.whole, index.read / index.whole)
