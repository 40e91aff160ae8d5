import random
from collections import Counter, defaultdict

from helpers import docs, texts

from menurank.llm import packing


def brute(lengths, sources, clusters, capacity):
    """Best fit written plainly: of the bins that fit and don't conflict, the one with the least room, then number."""
    bins, out = [], set()
    for i, n in enumerate(lengths):
        for k in range(n // capacity):
            out.add((i, k, k * capacity, capacity, len(bins), 0))
            bins.append([0, {sources[i]}, {clusters[i]}])
    rest = sorted((-(n % capacity), i, n // capacity) for i, n in enumerate(lengths) if n % capacity or not n)
    for n, i, k in rest:
        n = -n
        fit = [(b[0], at) for at, b in enumerate(bins) if b[0] >= n and sources[i] not in b[1] and clusters[i] not in b[2] and b[3:] != ["full"]]
        fit = [(left, at) for left, at in fit if at not in {o[4] for o in out if o[3] == capacity}]
        if fit:
            _, at = min(fit)
        else:
            at = len(bins)
            bins.append([capacity, set(), set()])
        out.add((i, k, k * capacity, n, at, capacity - bins[at][0]))
        bins[at][0] -= n
        bins[at][1].add(sources[i])
        bins[at][2].add(clusters[i])
    return out


def test_like_brute_force():
    for seed in range(30):
        rng = random.Random(seed)
        n = rng.randrange(1, 120)
        lengths = [rng.choice([0, rng.randrange(1, 40), rng.randrange(1, 300)]) for _ in range(n)]
        sources = [rng.choice([None, "hot", "hot", "a", "b", "c"]) for _ in range(n)]
        clusters = [rng.randrange(40) for _ in range(n)]
        assert set(packing.pack(lengths, sources, clusters, 100)) == brute(lengths, sources, clusters, 100)


def test_rows_and_conflicts(spark):
    rows = packing.document_pieces(docs(spark)).collect()
    by_doc, by_bin = Counter(), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]] += r["length"]
        by_bin[r["bin"]].append(r)
    want = Counter()
    for i, t in texts():
        want[i] += len(t or "")
    assert by_doc == want and {r["doc_id"] for r in rows} == {i for i, _ in texts()}
    for own in by_bin.values():
        assert sum(r["length"] for r in own) <= packing.CAPACITY and len({r["doc_id"] for r in own if r["doc_id"]}) == len([r for r in own if r["doc_id"]])
        at = 0
        for r in sorted(own, key=lambda r: (r["offset"], r["length"])):
            assert r["offset"] == at
            at += r["length"]
    assert packing.document_pieces(docs(spark, [])).count() == 0


def test_pieces_give_back_the_texts(spark):
    rows = [(i, "ä" * n + "b") for i, n in enumerate((0, 5, 9000, 20000))]
    df = docs(spark, rows)
    parts = defaultdict(list)
    for r in packing.filled(df, packing.document_pieces(df)).collect():
        parts[r["doc_id"]].append((r["piece"], r["text"]))
    assert {i: "".join(t for _, t in sorted(p)) for i, p in parts.items()} == dict(rows)


def test_partitioning_changes_nothing(spark):
    df = spark.range(5000).selectExpr("id as doc_id", "id * 37 % 9000 as length", "case when id % 3 = 0 then 'hot' else cast(id % 19 as string) end as source", "id % 900 as cluster")
    assert sorted(map(tuple, packing.packed(df).collect())) == sorted(map(tuple, packing.packed(df.repartition(7)).collect()))
