"""Exact top-k search by inner product with an impact-ordered, score-at-a-time index.

Vectors are cut into blocks. In a block each dimension has a posting list ordered by quantised impact, in segments of
equal impact. A query takes segments of all dimensions by descending contribution (its weight times the impact,
rounded up) and adds them to accumulators. After each round every vector has an upper bound: what it has gathered plus,
for each dimension not seen yet, the largest contribution left. A lower bound for the result is the k-th best exact score
known so far, in this block or, from a first search of one block, before. The search stops only once so few vectors have
an upper bound that reaches it that scoring them exactly is less work than going on; those are then scored exactly.

Each block's index is made once and kept in the shared folder. Queries (a fixed share of the rows) are copied to the
blocks, the vectors are not; a task streams the queries of one lot past one index, and gives k rows a query at most.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop, cached, pack, stored, table, unpack

TOP, SCALE, EVERY, LEVELS = 5, 256, 50, 64
BLOCK_ROWS, QUERY_ROWS = 32_768, 65_536
ROUNDS = (0.2, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.7, 0.8, 0.9, 1.0)  # share of the postings taken by each round
LEAST_TASKS = 8
MOST_BLIND = 8  # with more blocks, a search of one first is worth its cost
BROADCAST_QUERIES = 1_000_000  # 16 MB; only the plan depends on it


class ImpactIndex:
    """Postings of n vectors of d integers, in at most about LEVELS segments for each dimension: (dimension, first, end,
    low, high), impacts ascending. docs: the posting lists, if they are made already."""

    def __init__(self, vectors: np.ndarray, docs: np.ndarray | None = None, levels: int = LEVELS):
        self.vectors = vectors
        self.n, self.d = vectors.shape
        self.docs = np.argsort(vectors, axis=0, kind="stable").T.astype(np.intp) if docs is None else docs.astype(np.intp)  # d lists of n
        self.quantum = max(1, int(vectors.max(initial=0) - vectors.min(initial=0)) // levels)
        sorted_ = np.take_along_axis(vectors, self.docs.T, 0).T
        level = sorted_ // self.quantum
        first = np.ones(level.shape, bool)
        first[:, 1:] = level[:, 1:] != level[:, :-1]
        self.dim, self.begin = np.nonzero(first)
        self.end = np.append(self.begin[1:], 0)
        last = np.append(self.dim[1:] != self.dim[:-1], True)
        self.end[last] = self.n
        self.low, self.high = level[self.dim, self.begin] * self.quantum, (level[self.dim, self.begin] + 1) * self.quantum - 1
        self.read = self.whole = 0  # postings taken by all searches, and there were

    def search(self, query: np.ndarray, k: int, order: np.ndarray, own: np.ndarray, floor: float = -np.inf):
        """(positions, exact scores) of the k best but those of `own` (true for vectors out of question), ties to the
        smaller of order; of these, those that reach floor. Values must be so small that float64 sums are exact (see
        exact_in_float)."""
        k = min(k, self.n - int(own.sum()))
        if k < 1 or not self.d:
            found = np.flatnonzero(~own)[: max(0, k)] if k < 1 else np.flatnonzero(~own)[np.argsort(order[~own], kind="stable")[:k]]
            return found, np.zeros(len(found))
        weight = query[self.dim]
        most = np.maximum(weight * self.low, weight * self.high)
        by_most = np.argsort(-most, kind="stable")
        sizes = (self.end - self.begin)[by_most]
        taken = np.cumsum(sizes)
        # One sum holds both what a vector has gathered and, times a step beyond any gathered sum, how often it was seen.
        step = 2.0 ** np.ceil(np.log2(2.0 * float(np.abs(most).max(initial=0)) * self.d + 2))
        both, done = np.zeros(self.n), 0
        for share in ROUNDS:
            stop = len(by_most) if share == 1.0 else int(np.searchsorted(taken, share * taken[-1])) + 1
            now = by_most[done:stop]
            if len(now):
                docs = np.concatenate([self.docs[d, b:e] for d, b, e in zip(self.dim[now].tolist(), self.begin[now].tolist(), self.end[now].tolist())])
                both += np.bincount(docs, np.repeat(most[now] + step, self.end[now] - self.begin[now]), self.n)
            done = max(done, stop)
            left = most[by_most[done]] if done < len(by_most) else 0.0
            seen = np.rint(both / step)
            bound = both - step * seen + left * (self.d - seen)
            bound[own] = -np.inf
            best = np.argpartition(-bound, k - 1)[:k]
            least = max(floor, (self.vectors[best] @ query).min())  # k exact scores: the k-th best is no less
            members = np.flatnonzero(bound >= least)
            if done >= len(by_most) or len(members) * self.d <= taken[-1] - taken[done - 1]:
                break
        self.read, self.whole = self.read + int(taken[done - 1]), self.whole + int(taken[-1])
        scores = self.vectors[members] @ query
        top = np.lexsort((order[members], -scores))[:k]
        return members[top], scores[top]


def exact_in_float(vectors: np.ndarray, queries: np.ndarray) -> bool:
    most = lambda m: 2 * float(np.abs(m.astype(float)).max(initial=0)) + 1  # noqa: E731  a segment's bound may be a level beyond
    d = max(1, vectors.shape[1])
    return 8 * most(vectors) * most(queries) * d * d < 2.0**53  # sums of a step each, see ImpactIndex.search


def plain_search(vectors, query, k, order, own):
    """Python integers, for values beyond what float64 holds; scores beyond a long are cut to its range."""
    scores = [(-sum(int(a) * int(b) for a, b in zip(v, query)), int(order[i]), i) for i, v in enumerate(vectors) if not own[i]]
    best = sorted(scores)[:k]
    return [i for _, _, i in best], [max(-(2**63), min(2**63 - 1, -s)) for s, _, _ in best]


def whole(vector, scale: int = SCALE):
    """floor(scale * x) of each component, x as double; null for vectors that take no part. Beyond a long: its limit."""
    fine = F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(fine, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")))


def block_indexes(rows: DataFrame, blocks: int) -> DataFrame:
    """block, vec_id (ids as longs), v (the matrix), docs (posting lists; empty where values are too large for them), n:
    one row for each block, stored. rows: vec_id, v."""

    def build(t):
        import pyarrow as pa

        ids, lists = np.array(t.column("vec_id").to_pylist(), np.int64), t.column("v").to_pylist()
        order = np.argsort(ids, kind="stable")
        wide = max(map(len, lists), default=0)
        m = np.array([lists[i] + [0] * (wide - len(lists[i])) for i in order.tolist()], np.int64).reshape(len(lists), wide)
        docs = np.argsort(m, axis=0, kind="stable").T.astype(np.int32)
        return pa.table({"block": t.column("block")[:1], "vec_id": pa.array([pack(ids[order])], pa.binary()), "v": pa.array([pack(m)], pa.binary()), "docs": pa.array([pack(docs)], pa.binary()), "n": pa.array([len(ids)], pa.int64())})

    dealt = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(2), "vec_id", "v"), F.lit(blocks)).cast("int"))
    return stored(dealt.groupBy("block").applyInArrow(build, "block int, vec_id binary, v binary, docs binary, n long"))


def searched(index: DataFrame, queries: DataFrame, k: int, tasks: int) -> DataFrame:
    """query_id, vec_id, score: up to k best of each query in its block. queries: block, lot, query_id, q, floor."""
    lots = queries.select("block", "lot").distinct()
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    left = index.join(lots, "block").select("block", "lot", F.lit(0).alias("kind"), none("query_id", "long"), none("q", "array<long>"), none("floor", "long"), "vec_id", "v", "docs", "n")
    right = queries.select("block", "lot", F.lit(1).alias("kind"), "query_id", "q", "floor", none("vec_id", "binary"), none("v", "binary"), none("docs", "binary"), none("n", "long"))

    def search(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for r in b.to_pylist():
                if not r["kind"]:
                    ids, n = unpack(r["vec_id"], np.int64), r["n"]
                    whole_, docs = unpack(r["v"], np.int64).reshape(n, -1), unpack(r["docs"], np.int32).reshape(-1, n)
                    held = None
                    continue
                q = np.array(r["q"], np.int64)
                m = whole_
                if len(q) != m.shape[1]:  # the shorter is filled up with zeros, which add nothing
                    common = min(len(q), m.shape[1])
                    q = np.concatenate([q[:common], np.zeros(m.shape[1] - common, np.int64)])
                own = ids == r["query_id"]
                floor = -np.inf if r["floor"] is None else float(r["floor"])
                if exact_in_float(m, q) and abs(floor) in (np.inf, *([abs(floor)] if abs(floor) < 2.0**53 else [])):
                    held = held or ImpactIndex(m.astype(float), docs)
                    found, scores = held.search(q.astype(float), k, ids, own, floor)
                else:
                    found, scores = plain_search(m, q, k, ids, own)
                out += [(r["query_id"], int(ids[i]), int(x)) for i, x in zip(found, scores)]
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in range(3)], ["query_id", "vec_id", "score"])

    both = left.unionByName(right).repartition(tasks, "block", "lot").sortWithinPartitions("block", "lot", "kind", "query_id")
    return both.mapInArrow(search, "query_id long, vec_id long, score long")


def top_k(df: DataFrame, k: int = TOP, key: str = "vec_id", vector: str = "embedding", every: int = EVERY, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: for each key divisible by `every`, the k best rows of other keys by inner product.

    Null keys and unfit vectors take no part. Rows that share a key are all candidates, and are all queries whose scores
    are ranked together; of wholly equal rows k are enough. Shorter vectors are filled up with zeros. Other columns are
    ignored; an empty table gives no rows.
    """
    rows = df.select(F.col(key).cast("long").alias("vec_id"), whole(vector).alias("v")).filter("vec_id is not null and v is not null")
    rows = rows.groupBy("vec_id", "v").agg(F.count("*").alias("c")).select("vec_id", "v", F.explode(F.array_repeat(F.lit(1), F.least("c", F.lit(k)).cast("int"))).alias("c")).drop("c")
    total = max(1, df.count())
    blocks = -(-total // block_rows)
    lots = max(-(-total // (every * query_rows)), -(-LEAST_TASKS // blocks))  # an index is copied once a lot
    index = block_indexes(rows, blocks)
    queries = cached(rows.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.pmod(F.xxhash64(F.lit(1), "vec_id", "v"), F.lit(lots)).cast("int").alias("lot"), F.lit(None).cast("long").alias("floor")))
    there = F.array(*map(F.lit, range(blocks))) if blocks <= 100 else F.sequence(F.lit(0), F.lit(blocks - 1))
    asked = queries
    if blocks > MOST_BLIND:  # a search of one block each tells a score that the result reaches
        home = queries.withColumn("block", F.pmod(F.xxhash64(F.lit(3), "query_id"), F.lit(blocks)).cast("int"))
        best = W.partitionBy("query_id").orderBy(F.desc("score"))
        floors = searched(index, home, k, blocks * lots).withColumn("r", F.row_number().over(best)).filter(F.col("r") == k).select("query_id", F.col("score").alias("floor"))
        floors = stored(floors)
        asked = queries.drop("floor").join(F.broadcast(floors) if floors.count() <= BROADCAST_QUERIES else floors, "query_id", "left")
    asked = stored(asked.select("query_id", "q", "lot", "floor"))
    drop(queries)
    found = searched(index, asked.withColumn("block", F.explode(there)), k, blocks * lots)
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_topk(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"))


ORACLE = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint score from v q join v c on c.vec_id <> q.vec_id where q.vec_id % 50 = 0),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id) rank, vec_id, score from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 5"""

QUERIES = {"op1_topk": op1_topk}
SQL = {"op1_topk": ORACLE}
