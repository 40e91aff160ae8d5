import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from helpers import SF, docs, folder, texts

from menurank.llm import lm


def brute(rows):
    split = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) if w] + [None]
    trains = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2
    one, two, after = Counter(), Counter(), defaultdict(set)
    for i, t in rows:
        if trains(i):
            w = split(t)
            one.update(w)
            two.update(zip(["<s>", *w], w))
    for h, w in two:
        after[h].add(w)
    n, v = sum(one.values()), len(one)
    of = lambda c: lm.discounts([sum(x == r for x in c.values()) for r in range(1, 7)])
    d1, d2 = of(one), of(two)
    left = sum((1 - d1[min(x, 6)]) * x for x in one.values())
    e1 = 0 if left > 0 else 1
    p1 = lambda w: d1[min(one[w], 6)] * one[w] / (n + e1) if one[w] else (left + e1) / (n + e1)
    weights = {}
    for h, ws in after.items():
        c = sum(two[h, w] for w in ws)
        freed = sum((1 - d2[min(two[h, w], 6)]) * two[h, w] for w in ws)
        e = 0 if freed > 0 else 1
        weights[h] = (c + e, (freed + e) / (c + e) / (1 - sum(map(p1, ws))))
    p = lambda w, h: d2[min(two[h, w], 6)] * two[h, w] / weights[h][0] if two[h, w] else (weights[h][1] if h in weights else 1) * p1(w)
    for h in list(weights)[:50]:
        assert abs(sum(p(w, h) for w in one) + weights[h][1] * p1("never seen") - 1) < 1e-9
    out = []
    for i, t in rows:
        w = split(t)
        base = sum(math.log10((one[x] + 1) / (n + v + 1)) for x in w)
        out.append((-1 if i is None else i, not trains(i), len(w), sum(one[x] > 0 for x in w), n, base, sum(math.log10(p(x, h)) for h, x in zip(["<s>", *w], w))))
    return sorted(out)


def compare(got, want):
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-6, abs=2e-6)


def test_hard_rows(spark, tmp_path):
    compare(lm.op7_katz(spark, folder(spark, tmp_path)).collect(), brute(texts()))


def test_documents(spark, monkeypatch):
    monkeypatch.setattr(lm, "BATCH_DOCS", 17)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = lm.op7_katz(spark, SF).collect()
    compare(got, brute(rows))
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_nothing_to_learn_from(spark, tmp_path):
    assert lm.op7_katz(spark, folder(spark, tmp_path / "a", [])).count() == 0
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    (row,) = lm.op7_katz(spark, folder(spark, tmp_path / "b", [(only, "all held out")])).collect()
    assert row["train_tokens"] == 0 and row["n_known"] == 0 and row["base_score"] == 0 and math.isfinite(row["score"])


def test_discounts():
    assert all(0 < d < 1 for d in lm.discounts([1000, 400, 200, 120, 80, 60])[1:6])
    for odd in ([0] * 6, [5, 0, 0, 0, 0, 0], [1, 9, 9, 9, 9, 9]):
        assert all(0 < d < 1 for d in lm.discounts(odd)[1:6])


def test_discounts_are_good_turing_where_a_count_of_counts_sticks_out():
    """Counts of counts of the words and pairs of sf0.01 and sf0.1: N5 is large against N4."""
    for n in ([49663, 12919, 5197, 2729, 2383, 1067], [193655, 25105, 6496, 2179, 2497, 618], [207344, 59772, 25017, 14274, 13493, 7080], [1579638, 246704, 51653, 21705, 18939, 7580]):
        x, y = [math.log(r) for r in range(1, 7)], [math.log(c) for c in n]
        mx, my = sum(x) / 6, sum(y) / 6
        b = sum((p - mx) * (q - my) for p, q in zip(x, y)) / sum((p - mx) ** 2 for p in x)
        share, plain = [], True
        for r in range(1, 6):
            turing, fit = (r + 1) * n[r] / n[r - 1], r * (1 + 1 / r) ** (b + 1)
            error = math.sqrt((r + 1) ** 2 * n[r] / n[r - 1] ** 2 * (1 + n[r] / n[r - 1]))
            plain = plain and turing < r and turing / r > 6 ** (b + 1) and abs(turing - fit) > 1.65 * error
            share.append((turing if plain else fit) / r)
        want = [(s - 6 ** (b + 1)) / (1 - 6 ** (b + 1)) for s in share]
        got = lm.discounts(n)
        assert list(got[1:6]) == pytest.approx(want, rel=1e-9) and all(0 < d < 1 for d in want) and got[6] == 1
        assert share[0] == pytest.approx(2 * n[1] / n[0])  # Turing's own estimate, where counts are many
        cut = n[0] / (n[0] + 2 * n[1])
        assert max(abs(got[r] - 1 + cut / r) for r in range(1, 6)) > 0.05


def test_one_missing_count_of_counts_does_not_end_good_turing():
    got = lm.discounts([1000, 300, 120, 0, 50, 30])
    assert lm.slope([1000, 300, 120, 0, 50, 30]) is not None and all(0 < d < 1 for d in got[1:6])
    assert all(lm.slope(n) is None for n in ([0] * 6, [5, 0, 0, 0, 0, 0], [1, 9, 9, 9, 9, 9]))
