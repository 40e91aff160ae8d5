import base64
import dataclasses
import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from helpers import docs, texts
from pyspark.sql import functions as F

from menurank.llm import align

MORE = [(20, "a▁b"), (21, "▁"), (22, "<0x41> <|endoftext|> </s>"), (23, "nul \0 in"), (24, "  two  spaces \n\n"), (25, "日本語のテキスト"), (26, "naïve café — “quoted” 😀👍🏽"), (27, "x" * 5000 + " " * 5000), (28, "the cat of the house"), (29, "the cat of the dog"), (29, "the cat of the dog"), (30, " x﻿")]


@pytest.fixture(scope="module")
def files():
    return align.Files.read(P.path(align.A), P.path(align.RANKS), P.PATTERN, P.path(align.B))


@pytest.fixture(scope="module")
def libraries(files):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path(align.A))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=P.path(align.B))


def spans(sizes):
    out, at = [], 0
    for n in sizes:
        out.append((at, at + n))
        at += n
    return out


def plainly(every, libraries):
    """All token pairs tried for an overlap, one text after the other."""
    a, b = libraries
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(x): x for x in printable} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in printable)}
    made = []
    for i, t in every:
        whole = b" " + (t or "").encode()
        ia, ib = a.encode(" " + (t or ""), add_special_tokens=False).ids, b.encode(t or "")
        ta = [bytes(chars[c] for c in a.id_to_token(x)) for x in ia]
        tb = [bytes([int(b.id_to_piece(x)[3:5], 16)]) if b.is_byte(x) else b.id_to_piece(x).replace("▁", " ").encode() for x in ib]
        if not t or b"".join(ta) != whole or b"".join(tb) != whole:
            made.append((i, 0, 0, 0, [], ""))
            continue
        sa, sb = spans(map(len, ta)), spans(map(len, tb))
        near = [(m, n) for m, (s, e) in enumerate(sa) for n in range(len(sb)) if s < sb[n][1] and sb[n][0] < e]
        cuts = sorted({e for _, e in sa} & {e for _, e in sb})
        groups, at = [], 0
        for c in cuts:
            inside = lambda ids, place: ",".join(str(x) for x, (s, e) in zip(ids, place) if at <= s and e <= c)  # noqa: B023, E731
            groups.append(f"{inside(ia, sa)}|{inside(ib, sb)}")
            at = c
        made.append((i, len(ia), len(ib), len(cuts), [(ia[m], ib[n]) for m, n in near], ";".join(groups)))
    counts = Counter(p for row in made for p in set(row[4]))
    best = {}
    for (x, _), n in counts.items():
        best[x] = max(best.get(x, 0), n)
    return [(i, na, nb, g, len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), text) for i, na, nb, g, links, text in made]


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


@pytest.mark.parametrize("broadcast", [0, 10**6])
def test_like_trying_all_token_pairs(spark, files, libraries, monkeypatch, broadcast):
    monkeypatch.setattr(align, "BROADCAST_PAIRS", broadcast)
    every = [(i, t if not t or len(t) < 9000 else t[:9000]) for i, t in texts()] + MORE
    want = plainly(every, libraries)
    out = align.aligned(docs(spark, every).repartition(3), files)
    assert "text" not in out.columns and out.columns.count("n_a") == 1 and "aligned_row" not in out.columns
    got = [tuple(r[c] for c in COLUMNS) for r in out.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and sum(r[5] < r[4] for r in want) > 3
    assert {i for i, *_, text in got if not text} == {3, 4, 20, 21, None} | ({i for i, *_, t in want if not t})


def test_whole_long_texts_and_digests(spark, files, libraries):
    rng = random.Random(3)
    long = " ".join(rng.choice(["the", "naïve", "zqx", "日本", "cat"]) for _ in range(60_000))
    out = align.aligned(docs(spark, [(1, long), (2, "the cat")]), files, keep=align.sha256)
    plain = align.aligned(docs(spark, [(1, long), (2, "the cat")]), files)
    a, b = libraries
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[1]["n_a"] == len(a.encode(" " + long).ids) and got[1]["n_b"] == len(b.encode(long))
    assert got[1]["n_links"] == got[1]["n_a"] + got[1]["n_b"] - got[1]["n_groups"]
    assert {r["doc_id"]: hashlib.sha256(r["groups"].encode()).hexdigest() for r in plain.collect()} == {i: r["groups"] for i, r in got.items()}
    assert {r["groups"] for r in align.aligned(docs(spark, MORE), files, keep=None).collect()} == {""}
    assert align.aligned(docs(spark, []), files).count() == 0


def test_the_fast_library_is_the_named_one(files, libraries):
    both, rng = align.Both(files), random.Random(8)
    a, _ = libraries
    ranks = list(files.ranks)
    kinds = [lambda: rng.randrange(128), lambda: rng.randrange(0x250), lambda: rng.randrange(0x250, 0xD800), lambda: rng.randrange(0xE000, 0x110000)]
    lines = ["".join(chr(rng.choice(kinds)()) for _ in range(rng.randrange(40))) for _ in range(4000)]
    lines += [b"".join(rng.choice(ranks) for _ in range(rng.randrange(1, 4))).decode("utf-8", "ignore") for _ in range(8000)] + ["".join(rng.choice("aeinorst lé\n'.1") for _ in range(60)) for _ in range(4000)]
    assert all(both.encode_a(t).tolist() == a.encode(t, add_special_tokens=False).ids for t in lines)
    slow = align.Both(dataclasses.replace(files, odd="."))  # as if the two never agreed
    assert all(slow.encode_a(t).tolist() == both.encode_a(t).tolist() for t in lines[:500] if t)
    assert slow.slow and all(x == y for x, y in zip(both.a.sizes, slow.a.sizes))


def test_labels_and_byte_level():
    assert align.labelled(5, np.array([1, 3, 5]), np.array([3, 4, 5])).tolist() == [1, 0, 3, 2, 3]
    levels = align.byte_level()
    assert sorted(levels.values()) == list(range(256)) and levels["Ġ"] == 32 and levels["a"] == 97
    assert base64.b64encode(bytes([levels["Ċ"]])) == b"Cg=="


def test_counts_are_by_document(spark):
    rows = spark.createDataFrame([([1, 12],), ([1],), ([11, 13],), ([],)], "pairs array<long>")
    got = {(r["pair"], r["n"], r["best"]) for r in align.pair_counts(rows, 10).select("pair", F.col("n"), "best").collect()}
    assert got == {(1, 2, True), (11, 1, True), (12, 1, True), (13, 1, True)}
