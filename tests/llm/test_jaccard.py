import random
import re

import pytest
from helpers import docs

from menurank.llm import common, graph, jaccard
from menurank.llm.jaccard import jaccard_classes


def brute(rows, width, percent):
    rows = [(i, t) for i, t in rows]

    def grams(t):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) if x]
        return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())

    sets = [grams(t) for _, t in rows]
    up = {i: i for i, _ in rows if i is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if rows[x][0] is not None and rows[y][0] is not None and both and 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                a, b = find(rows[x][0]), find(rows[y][0])
                up[max(a, b)] = min(a, b)
    return [(i, len(s), None if i is None else find(i)) for (i, _), s in zip(rows, sets)]


def got(df, width, percent):
    return [tuple(r) for r in jaccard_classes(df, width, percent).select("doc_id", "n_shingles", "component_id").collect()]


def test_hard_rows(spark):
    from helpers import same, texts

    assert same(got(docs(spark), 4, 85), brute(texts(), 4, 85))


@pytest.mark.parametrize(("seed", "percent", "block"), [(1, 85, 2048), (2, 80, 3), (3, 60, 3)])
def test_near_copies_of_every_degree(spark, monkeypatch, seed, percent, block):
    """Also with posting lists dealt into blocks of about three groups."""
    from helpers import same

    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(6):
        base = [rng.choice(words) for _ in range(rng.randrange(5, 90))]
        for _ in range(rng.randrange(5, 40)):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5, 8])):
                how, at = rng.randrange(3), rng.randrange(len(t) + 1)
                if how == 0 and at < len(t):
                    t[at] = rng.choice(words)
                elif how == 1:
                    t.insert(at, rng.choice(words))
                elif len(t) > 1 and at < len(t):
                    del t[at]
            rows.append((n := n + rng.randrange(1, 4), " ".join(t)))
        rows += [(n := n + 1, " ".join(base + words[k : k + 3])) for k in range(5)]
    line = "a common line of nine words is put here"
    rows += [(n := n + 1, line + " " + " ".join(rng.choice(words) for _ in range(rng.randrange(8)))) for _ in range(40)]
    rng.shuffle(rows)
    assert same(got(docs(spark, rows, False), 4, percent), brute(rows, 4, percent))


def test_empty_table(spark):
    assert got(docs(spark, []), 4, 85) == []


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(200, x) for x in range(201, 260)] + [(5, 5), (300, 301), (301, 300), (None, 1)]
    found = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(61)}, **{i: 200 for i in range(200, 260)}, 300: 300, 301: 300}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_long_words_of_one_pattern_do_not_collide(spark):
    """Thue and Morse's words: a polynomial modulo 2**64 gives them equal hashes, whatever its odd base."""
    from helpers import same

    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    rows = [(1, f"{a} {b} {a}{b} {b}{a} {a} x"), (2, f"{b} {a} {b}{a} {a}{b} {b} x"), (3, " ".join([a[:7], a[:8], a[:9]] * 3)), (4, " ".join([b[:7], b[:8], b[:9]] * 3))]
    assert same(got(docs(spark, rows, False), 4, 85), brute(rows, 4, 85)) and [c for _, _, c in brute(rows, 4, 85)] == [1, 2, 3, 4]


def test_word_hashes_are_one_for_each_word():
    import pyarrow as pa
    from helpers import texts

    rng = random.Random(5)
    some = [None, "", *(t for _, t in texts()), *("".join(rng.choice("aAb é\n\t\x1c😀") for _ in range(rng.randrange(60))) for _ in range(500)), "y" * 300, "Y" * 300, "y" * 301, "a\x00", "a"]
    column = pa.array(["skipped", *some, "too"])[1:-1]
    h, firsts = common.word_hashes(column)
    known = {}
    for t, a, b in zip(some, firsts, firsts[1:]):
        words = common.ascii_words(t)
        assert len(words) == b - a
        for w, x in zip(words, h[a:b].tolist()):
            assert known.setdefault(w, x) == x
    assert len(set(known.values())) == len(known) > 500
    assert len(common.word_hashes(pa.array([], pa.string()))[0]) == 0


def test_slices_are_bounded_by_bytes():
    import pyarrow as pa

    rows = ["x" * n for n in (0, 5, 3, 20, 1, 1, 0, 9)] + [None]
    got = [b.column("text").to_pylist() for b in common.slices(pa.RecordBatch.from_pydict({"text": rows}), limit=9)]
    assert [t for b in got for t in b] == rows and all(len(b) == 1 or sum(len(t or "") for t in b) <= 9 for b in got)


def test_only_long_lists_are_dealt_whatever_the_slots(spark, monkeypatch):
    """With 16 slots all tokens share a slot with frequent ones; lists are still dealt by their own lengths."""
    from helpers import same
    from pyspark.sql import functions as F

    monkeypatch.setattr(jaccard, "LEAST_BITS", 4)
    monkeypatch.setattr(jaccard, "MOST_BITS", 4)
    monkeypatch.setattr(jaccard, "CHUNKS", 4)
    rng = random.Random(11)
    rows = [(i, " ".join(f"w{rng.randrange(60)}" for _ in range(rng.randrange(6, 14)))) for i in range(80)]
    rows += [(100 + i, t + " end") for i, (_, t) in enumerate(rows[:40])]
    assert same(got(docs(spark, rows, False), 4, 70), brute(rows, 4, 70))
    postings = spark.createDataFrame([(k, 0, t) for t, n in ((1, 1), (2, 10), (3, 11), (4, 95)) for k in range(n)], "k long, at int, token long")
    out, long = jaccard.dealt(postings, 10)
    told = {r["token"]: (r["n"], r["blocks"], r["used"]) for r in out.groupBy("token").agg(F.count("*").alias("n"), F.max("blocks").alias("blocks"), F.count_distinct("block").alias("used")).collect()}
    assert told[1] == (1, 1, 1) and told[2] == (10, 1, 1) and told[3][:2] == (11, 2) and told[4][:2] == (95, 10) and told[4][2] > 5
    long.unpersist()


def test_rows_that_may_link_meet_once_and_rows_are_repeated_little(spark):
    rng = random.Random(12)
    lists = {1: [rng.randrange(1, 4000) for _ in range(300)], 2: [100] * 120, 3: [20, 21], 4: [9, 40, 41]}
    rows = [(t, 1000 * t + k, n) for t, sizes in lists.items() for k, n in enumerate(sizes)]
    block = 10
    left, right = jaccard.paired(spark.createDataFrame(rows, "token long, g long, n long"), 80, block)
    a, b = ([(r["token"], tuple(r["meet"]), r["g"], r["n"]) for r in x.collect()] for x in (left, right))
    by = {}
    for t, m, g, n in b:
        by.setdefault((t, m), []).append((g, n))
    met = [tuple(sorted((g, h))) for t, m, g, n in a for h, k in by.get((t, m), ()) if m[0] == 1 or m[2] < m[3] or g < h]
    assert len(met) == len(set(met))
    wanted = {(g, h) for i, (t, g, n) in enumerate(rows) for u, h, k in rows[i + 1 :] if t == u and 100 * min(n, k) >= 80 * max(n, k)}
    assert wanted <= set(met)
    every = sum(len(s) * (len(s) - 1) // 2 for s in lists.values())
    assert len(met) < every * 0.6  # far sizes are never put side by side
    for t, sizes in lists.items():
        most = max(sum(1 for n in sizes if abs(n - m) <= 0.5 * m) for m in sizes)  # rows of neighbouring classes
        assert sum(x[0] == t for x in a) + sum(x[0] == t for x in b) <= len(sizes) * (4 + 2 * (most // block + 2))
    assert sum(x[0] in (3, 4) for x in a + b) <= 4 * 5
