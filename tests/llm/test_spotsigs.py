import hashlib
import random
import re

import pytest
from helpers import docs, texts
from pyspark.sql import functions as F

from menurank.llm import spotsigs as S


def brute(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    spots, out = S.Spots(), []
    for at, (i, t) in enumerate(rows):
        after = rows[(at + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        a, b, c = spots(t), spots(edited), spots(after)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), S.written(a), S.written(b), S.likeness(a, b), S.likeness(a, c)))
    return sorted(map(repr, out))


def got(df, part_rows):
    return sorted(repr(tuple(r)) for r in S.compared(df, part_rows).collect())


def test_hard_rows_in_ranges_of_any_size(spark):
    for n in (1, 3, 1000):
        assert got(docs(spark), n) == brute(texts())


def test_next_documents_over_many_ranges(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(10**6) * 10**12, f"the word{i} goes of house{i % 7} and tree{i % 5} is green{i}") for i in range(400)]
    assert got(docs(spark, rows, False).repartition(6), 20) == brute(rows)
    assert got(docs(spark, rows[:1]), 20) == brute(rows[:1])
    assert S.compared(docs(spark, [])).count() == 0


def test_signatures():
    spots = S.Spots()
    a = spots("The quick fox of green hills and blue lakes runs")
    assert len(a) == 3 and len(spots("")) == 0 and len(spots("only content words")) == 1
    assert S.likeness(a, spots("the QUICK, fox; of green hills and blue lakes runs!")) == 1
    assert 0 < S.likeness(a, spots("The quick fox of green hills and red lakes runs")) < 1
    assert S.likeness(a, a[:1], 0.9) == 0 and (S.read(S.written(a)) == a).all()
    assert S.likeness(a[:0], a[:0]) == 1 and S.likeness(a[:0], a) == 0


def test_each_range_ends_with_its_guest(spark):
    df = spark.range(100).select((F.col("id") * 3).alias("k"))
    rows = [tuple(r) for r in S.with_next(df, "k", 10).collect()]
    own, guests = [r for r in rows if not r[2]], [r for r in rows if r[2]]
    assert sorted(r[0] for r in own) == [i * 3 for i in range(100)]
    parts = sorted({r[1] for r in own})
    firsts = {p: min(r[0] for r in own if r[1] == p) for p in parts}
    assert {r[1]: r[0] for r in guests} == {p: firsts[parts[(n + 1) % len(parts)]] for n, p in enumerate(parts)}


def plain_signatures(text):
    """The chains as words: an anchor and the next two words that are none; without any, all words as one."""
    anchors = set(S.ANCHORS.split())
    words = "".join(c for c in re.sub("[A-Z]", lambda m: m.group().lower(), text or "") if c not in ".,;:!?\"'()")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", words) if w]
    out = set()
    for i, w in enumerate(words):
        content = [x for x in words[i + 1 :] if x not in anchors][:2]
        if w in anchors and len(content) == 2:
            out.add((w, *content))
    return out or ({tuple(words)} if words else set())


def test_signatures_are_the_plain_chains():
    rng = random.Random(8)
    spots, known = S.Spots(), {}
    for t in [" ".join(rng.choice(["the", "of", "Fox,", "hill", "lake!", "é", "und", "x"]) for _ in range(rng.randrange(15))) for _ in range(500)]:
        plain = plain_signatures(t)
        assert len(spots(t)) == len(plain)
        assert known.setdefault(frozenset(plain), S.written(spots(t))) == S.written(spots(t))
    assert len(set(known.values())) == len(known) > 200


@pytest.mark.parametrize(("least", "list_rows"), [(0.8, 2048), (0.5, 3)])
def test_near_pairs_like_brute_force(spark, least, list_rows):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(60)]
    rows = [(i + 1000, t) for i, t in enumerate(["", None, "the", "only content words"])] + [(None, "the fox of hill and lake")]
    for g in range(12):
        base = [rng.choice([*words, *["the", "of", "and"] * 6]) for _ in range(rng.randrange(60, 260))]
        for k in range(12):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((g * 20 + k, " ".join(t)))
    sets = {i: frozenset(plain_signatures(t)) for i, t in rows if i is not None and plain_signatures(t)}
    of = {i: min(j for j in sets if sets[j] == sets[i]) for i in sets}
    ids = sorted(set(of.values()))
    like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    want = {(a, b, round(like(a, b), 9)) for a in ids for b in ids if a < b and like(a, b) >= least}
    members, pairs = S.near_pairs(docs(spark, rows), least, list_rows)
    assert {tuple(r) for r in members.collect()} == set(of.items())
    got = [(r["a"], r["b"], round(r["likeness"], 9)) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20
    assert [f.count() for f in S.near_pairs(docs(spark, []))] == [0, 0]
