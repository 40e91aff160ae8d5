import hashlib
import random
import struct

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from helpers import docs, texts

from menurank.llm import bpe


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(P.path(bpe.VOCABULARY))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_like_the_library(ranks, library):
    rng = random.Random(4)
    kinds = [lambda: rng.randrange(32, 127), lambda: rng.randrange(1, 0x250), lambda: rng.randrange(0x250, 0xD800), lambda: rng.randrange(0xE000, 0x30000)]
    lines = ["".join(chr(rng.choice(kinds)()) for _ in range(rng.randrange(50))) for _ in range(3000)]
    lines += ["".join(rng.choice("aab cé\n'") for _ in range(rng.randrange(200))) for _ in range(1000)] + [t or "" for _, t in texts()]
    split, spell = bpe.Splitter(P.PATTERN, bpe.newer_letters()), bpe.Speller(ranks)
    words = sorted({p.encode() for t in lines for p in split(t)})
    known = dict(zip(words, bpe.replay(words, ranks), strict=True))  # one list for all texts
    for t in lines:
        ids = [i for p in split(t) for i in known[p.encode()]]
        assert ids == library.encode_ordinary(t) and spell(np.array(ids, int)) == t.encode()
    assert split.plain and all([m.group() for m in split.plain.finditer(t)] == split.pattern.findall(t) for t in lines if not split.beyond.search(t))


def test_lowest_rank_first_even_where_a_merge_makes_a_lower_one():
    ranks = {bytes([b]): 100 + b for b in range(256)} | {b"xy": 20, b"ab": 21, b"abc": 5, b"cab": 6, b"abca": 7, b"aba": 8, b"bc": 9}
    rng = random.Random(9)

    def plain(w):
        if w in ranks:
            return [ranks[w]]
        parts = [bytes([b]) for b in w]
        while found := [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]:
            _, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [ranks[p] for p in parts]

    words = [bytes(rng.choice(b"aabbccxy") for _ in range(rng.randrange(1, 30))) for _ in range(5000)]
    assert bpe.replay(words, ranks) == [plain(w) for w in words]


@pytest.mark.parametrize(("docs_each", "chars"), [(1, 10), (10**6, 10**9)])
def test_batches_and_parts_of_any_size(spark, ranks, library, monkeypatch, docs_each, chars):
    monkeypatch.setattr(bpe, "BATCH_CHARS", chars)
    got = {(r["doc_id"], r["ids_sha256"]) for r in bpe.encoded(docs(spark).repartition(3), ranks, P.PATTERN, part_docs=docs_each).collect()}
    ids = lambda t: struct.pack(f"<{len(x := library.encode_ordinary(t or ''))}I", *x)
    assert got == {(i, hashlib.sha256(ids(t)).hexdigest()) for i, t in texts()}


def test_rows(spark, ranks, library):
    out = bpe.encoded(docs(spark), ranks, P.PATTERN)
    assert "text" not in out.columns and out.columns.count("n_tokens") == 1
    got = sorted((r["doc_id"] or 0, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in out.collect())
    ids = lambda t: struct.pack(f"<{len(x := library.encode_ordinary(t or ''))}I", *x)
    assert got == sorted((i or 0, len(ids(t)) // 4, hashlib.sha256(ids(t)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in texts())
    back = bpe.decoded(out.select("doc_id", "ids"), ranks)
    assert sorted(bytes(r["decoded"]) for r in back.collect()) == sorted((t or "").encode() for _, t in texts())
    assert bpe.encoded(docs(spark, []), ranks, P.PATTERN).count() == 0


def test_batches_split_otherwise_when_read_again(spark, ranks, library, tmp_path, monkeypatch):
    """Between the two readings of the input its partitions change: answers no longer fit their batches, results still do."""
    from pyspark.sql import functions as F

    rows = [(i, f"some words{i} and more {i * i} " * (1 + i % 3)) for i in range(60)] + [(100, None), (101, "")]
    path = str(tmp_path / "docs")
    docs(spark, rows).repartition(6).write.parquet(path)
    monkeypatch.setattr(bpe, "BATCH_CHARS", 200)
    out = bpe.encoded(spark.read.parquet(path), ranks, P.PATTERN)  # the first reading is done here
    files = spark.read.parquet(path).select(F.input_file_name()).distinct().count()
    assert files > 1
    moved = spark.read.parquet(path).repartition(2).cache()
    assert moved.count() == 62
    moved.write.mode("append").parquet(str(tmp_path / "new"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = {r["doc_id"]: r["ids_sha256"] for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        moved.unpersist()
    ids = lambda t: struct.pack(f"<{len(x := library.encode_ordinary(t or ''))}I", *x)
    assert got == {i: hashlib.sha256(ids(t)).hexdigest() for i, t in rows}


@pytest.fixture
def small_arrow_batches(spark):
    """A batch can end with each Arrow batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_answers_without_their_batch_make_no_rows_and_no_error(spark, ranks, library, monkeypatch, small_arrow_batches):
    """Between the two readings batches become larger, so that later numbers have answers but no texts."""
    rows = [(i, f"words{i} of text {i}") for i in range(40)]
    monkeypatch.setattr(bpe, "BATCH_DOCS", 2)
    stored, held = bpe.stored, []

    def larger(df):
        held.append(stored(df))
        monkeypatch.setattr(bpe, "BATCH_DOCS", 16)
        return held[-1]

    monkeypatch.setattr(bpe, "stored", larger)
    out = bpe.encoded(docs(spark, rows).coalesce(1), ranks, P.PATTERN)
    assert held[0].select("batch").distinct().count() == 20
    want = {i: hashlib.sha256(struct.pack(f"<{len(x := library.encode_ordinary(t))}I", *x)).hexdigest() for i, t in rows}
    assert [r["doc_id"] for r in out.orderBy("doc_id").collect()] == list(range(40)) and {r["doc_id"]: r["ids_sha256"] for r in out.collect()} == want


def test_rows_exchanged_grow_with_the_corpus_at_most(spark, ranks, monkeypatch, small_arrow_batches):
    """Each batch has its own pieces; four times the documents make four times the batches and parts."""
    monkeypatch.setattr(bpe, "BATCH_DOCS", 5)
    made = []
    stored = bpe.stored
    monkeypatch.setattr(bpe, "stored", lambda df: made.append(stored(df)) or made[-1])
    for n in (50, 200):
        rows = [(i, f"word{i} other{i * 7}") for i in range(n)]
        bpe.encoded(docs(spark, rows, False).coalesce(1), ranks, P.PATTERN, part_docs=1).count()
    few, many = (m.count() for m in made)
    assert [m.select("batch").distinct().count() for m in made] == [10, 40]
    pieces = 4 * 5  # of a batch, at most: letters and numbers of two words
    assert few <= 10 * pieces and many <= 40 * pieces and many <= 4.5 * few
