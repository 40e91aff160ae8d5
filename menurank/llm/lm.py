"""Katz backoff language model of order 2, with Good-Turing discounts and exactly normalised backoff weights.

    P(w | h) = d(r) * r / (c(h) + e(h))        for a pair seen r times in training
             = alpha(h) * P(w)                 otherwise;  alpha = 1 for a history never seen
    P(w)     = d1(c) * c / (N + e)             for a word of training
             = what that leaves                for any other: all unknown words are one type, as in the base score

d are Katz's discounts for r to 5, from counts of counts smoothed as Simple Good-Turing does; e is 1 where no follower of h (no word) has a count that is
discounted, else 0, so that something is always left; alpha(h) makes P(. | h) sum to 1 exactly.

Texts are packed in batches of token numbers once. N-gram tables are partitioned by hash: each batch sends its distinct
keys and training counts to the partitions and gets back, in the same order, what its tokens need (the exchange below).
Three exchanges make the model and its use: words, pairs, histories. Keys move as packed arrays, so rows are few, and
each partition holds a bounded number of keys, whatever a word's or pair's frequency.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, ascii_words, fold, pack, stored, table, unpack

FOLDS, HELD_OUT, DISCOUNTED = 7, 2, 5
BATCH_CHARS, BATCH_DOCS, TABLE_KEYS, LEAST_TABLES = 8_000_000, 4096, 1_500_000, 16

BATCH = "batch long, kind int, part int, a binary, b binary, c binary, d binary"
SENT = "part int, batch long, keys binary, x binary, y binary, z binary"


def _pack_keys(keys: np.ndarray) -> bytes:
    """Ascending hashes by their differences, which take some bits less."""
    return pack(np.diff(keys, prepend=np.uint64(0)))


def _unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def _marks() -> tuple[int, int]:
    """Hashes of the start and the end of a text; no word has a space in it."""
    return tuple(int(x) for x in WordHashes().of([b" start", b" end"]))


def packed(docs: DataFrame) -> DataFrame:
    """Batches: a is the sorted hashes of its words and marks, b the places in a by falling frequency and then the tokens
    as places in that list, c the lengths of texts, d doc_id, whether it is null and whether the text is for training."""

    def gather(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        known = WordHashes()
        start, _ = _marks()
        number = TaskContext.get().partitionId() << 32
        texts, ids, train, chars = [], [], [], 0

        def flush():
            words, places = np.unique(np.concatenate([*texts, np.array([start], np.uint64)]), return_inverse=True)
            lengths = np.array([len(t) for t in texts], np.int32)
            about = np.array([(i or 0, i is None, t) for i, t in zip(ids, train, strict=True)], np.int64)
            order = np.argsort(-np.bincount(places), kind="stable").astype(np.int32)
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order), dtype=np.int32)
            cells = [_pack_keys(words), pack(np.concatenate([order, rank[places[:-1]]])), pack(lengths), pack(about)]
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([0], pa.int32()), pa.array([0], pa.int32()), *(pa.array([x], pa.binary()) for x in cells)], ["batch", "kind", "part", "a", "b", "c", "d"])

        for b in batches:
            for i, text, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("train").to_pylist(), strict=True):
                texts.append(known.of([*ascii_words(text), b" end"]))
                ids.append(i)
                train.append(t)
                chars += len(text or "")
                if chars >= BATCH_CHARS or len(texts) >= BATCH_DOCS:
                    yield flush()
                    number += 1
                    texts, ids, train, chars = [], [], [], 0
        if texts:
            yield flush()

    return docs.select("doc_id", "text", "train").mapInArrow(gather, BATCH)


@dataclass
class Batch:
    """One batch with what the exchanges have told it so far."""

    words: np.ndarray
    tokens: np.ndarray
    lengths: np.ndarray
    about: np.ndarray
    told: dict  # kind: arrays by partition, joined

    @classmethod
    def of(cls, rows, kinds: dict[int, type]) -> "Batch":
        own, told = None, {k: [] for k in kinds}
        for kind, part, a, b, c, d in zip(*(rows.column(x).to_pylist() for x in ("kind", "part", "a", "b", "c", "d")), strict=True):
            if kind == 0:
                words, ranked = _unpack_keys(a), unpack(b, np.int32)
                own = words, ranked[: len(words)][ranked[len(words) :]], unpack(c, np.int32), unpack(d, np.int64).reshape(-1, 3)
            else:
                told[kind].append((part, unpack(a, kinds[kind])))
        joined = {k: np.concatenate([x for _, x in sorted(v, key=lambda x: x[0])]) if v else np.zeros(0, kinds[k]) for k, v in told.items()}
        return cls(*own, joined)

    def train(self) -> np.ndarray:
        return np.repeat(self.about[:, 2].astype(bool), self.lengths)

    def pairs(self):
        """Distinct pairs' hashes, ascending; a place of each; each token's pair; each token's history."""
        start = np.searchsorted(self.words, np.uint64(_marks()[0]))
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[np.cumsum(self.lengths) - self.lengths] = start
        x = self.words[before] * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9) + self.words[self.tokens]
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        keys, at, pair = np.unique(x ^ (x >> np.uint64(32)), return_index=True, return_inverse=True)
        return keys, at, pair, before


def _slices(keys: np.ndarray, parts: int):
    """Part and slice of each part that has keys; keys ascend and parts cut the range of hashes evenly."""
    cuts = np.searchsorted(keys, np.array([(p << 64) // parts for p in range(1, parts)], np.uint64)) if parts > 1 else []
    ends = [0, *map(int, cuts), len(keys)]
    return [(p, slice(s, e)) for p, (s, e) in enumerate(zip(ends, ends[1:])) if e > s]


def _send(number: int, keys: np.ndarray, parts: int, *values: np.ndarray):
    """Rows of SENT for these keys and up to three arrays of values."""
    import pyarrow as pa

    cut = _slices(keys, parts)
    columns = [[pack(v[s]) for _, s in cut] for v in values] + [[None] * len(cut)] * (3 - len(values))
    return pa.table([pa.array([p for p, _ in cut], pa.int32()), pa.array([number] * len(cut), pa.int64()), pa.array([_pack_keys(keys[s]) for _, s in cut], pa.binary()), *(pa.array(c, pa.binary()) for c in columns)], names=["part", "batch", "keys", "x", "y", "z"])


def _answers(rows, kind: int, answer, counts_of_counts: bool):
    """Rows of BATCH for each row of SENT of one partition; answer maps its joined keys and rows to an array. With
    counts of counts, a row of batch -1 has them (answer gives them second)."""
    import pyarrow as pa

    keys = [_unpack_keys(k) for k in rows.column("keys").to_pylist()]
    told, counts = answer(np.concatenate(keys), rows)
    ends = np.cumsum([0, *map(len, keys)])
    batches, part = rows.column("batch").to_pylist(), rows.column("part")[0].as_py()
    out = [(b, kind, part, pack(told[s:e])) for b, s, e in zip(batches, ends, ends[1:])]
    if counts_of_counts:
        out.append((-1, kind, part, counts.astype(np.int64).tobytes()))
    empty = pa.nulls(len(out), pa.binary())
    return pa.table([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.int32()), pa.array([r[3] for r in out], pa.binary()), empty, empty, empty], names=["batch", "kind", "part", "a", "b", "c", "d"])


def _joined(rows, column: str, kind) -> np.ndarray:
    return np.concatenate([unpack(x, kind) for x in rows.column(column).to_pylist()])


def _count(keys: np.ndarray, rows):
    """Training counts of keys, twice, plus 1 for the first of equal keys; counts of counts 1 to 6, types and tokens."""
    _, first, at = np.unique(keys, return_index=True, return_inverse=True)
    total = np.bincount(at, _joined(rows, "x", np.uint32), len(first)).astype(np.uint64)
    told = total[at] << np.uint64(1)
    told[first] |= np.uint64(1)
    of = np.bincount(np.minimum(total, DISCOUNTED + 2).astype(np.int64), minlength=DISCOUNTED + 3)
    return told, np.array([*of[1 : DISCOUNTED + 2], (total > 0).sum(), total.sum()])


def slope(counts: list[int]) -> float | None:
    """Slope of the log-linear fit of counts of counts (from 1), each spread over the gaps beside it, as Simple
    Good-Turing does; None where fewer than two aren't 0 or where it isn't below -1, so that it can't discount."""
    r = [i for i, n in enumerate(counts, 1) if n]
    if len(r) < 2:
        return None
    before, after = [0, *r[:-1]], [*r[1:], 2 * r[-1] - r[-2]]
    spread = [2 * counts[i - 1] / (t - q) for i, q, t in zip(r, before, after, strict=True)]
    b = float(np.polyfit(np.log(r), np.log(spread), 1)[0])
    return b if b < -1 - 1e-9 else None


def discounts(counts: list[int]) -> np.ndarray:
    """d for counts 0 to DISCOUNTED + 1, the last for all greater ones (1). counts: counts of counts from 1.

    Katz's discounts of Simple Good-Turing's adjusted counts: Turing's own r* up to the first r whose r* gives no d
    between 0 and 1 or is within 1.65 standard deviations of the fit's r*, from there on the fit's. Where there is no
    fit (see slope), an absolute discount N1 / (N1 + 2 N2), held between 0.1 and 0.9.
    """
    n, k = [0, *counts], DISCOUNTED
    out = np.ones(k + 2)
    b = slope(counts[: k + 1])
    if b is None:
        cut = min(0.9, max(0.1, n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0.5))
        out[1 : k + 1] = [1 - cut / r for r in range(1, k + 1)]
        return out
    common, raw = (k + 1.0) ** (b + 1), True
    for r in range(1, k + 1):
        kept = (1 + 1 / r) ** (b + 1)  # the fit's r* / r
        raw = raw and n[r] > 0 and n[r + 1] > 0
        if raw:
            turing = (r + 1) * n[r + 1] / n[r] / r
            spread = (r + 1) / n[r] * np.sqrt(n[r + 1] * (1 + n[r + 1] / n[r])) / r
            raw = common < turing < 1 and abs(turing - kept) > 1.65 * spread
        out[r] = ((turing if raw else kept) - common) / (1 - common)
    return out


@dataclass
class Model:
    """What all batches share: a few numbers."""

    tokens: int
    types: int
    d1: np.ndarray
    d2: np.ndarray
    unknown: float
    reserved: int

    @classmethod
    def of(cls, words: list[int], pairs: list[int]) -> "Model":
        d1, (*n, types, tokens) = discounts(words[: DISCOUNTED + 1]), words
        cut = sum((1 - d1[r]) * r * n[r - 1] for r in range(1, DISCOUNTED + 1))
        e = 0 if cut > 0 else 1
        return cls(tokens, types, d1, discounts(pairs[: DISCOUNTED + 1]), (cut + e) / (tokens + e), e)

    def word(self, counts: np.ndarray) -> np.ndarray:
        """P(w) by training count."""
        p = self.d1[np.minimum(counts, DISCOUNTED + 1)] * counts / max(1, self.tokens + self.reserved)
        return np.where(counts > 0, p, self.unknown)


def _counts(table_: DataFrame) -> list[int]:
    """Sums of the counts of counts (a row of eight numbers for each partition)."""
    rows = table_.filter("batch = -1").select("a").collect()
    return [int(x) for x in sum((np.frombuffer(r["a"], np.int64) for r in rows), np.zeros(DISCOUNTED + 3, np.int64))]


def katz_scores(docs: DataFrame, train: str = "train") -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score, score for each row of docs.

    Null texts count as empty: such a text has one token, its end. Null doc_ids stay null. Repeated rows are learnt
    from and scored each. Without training text every word is unknown and has probability 1. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(train).alias("train"))
    batches = stored(packed(rows))

    def tables(keys: int) -> int:
        return max(LEAST_TABLES, -(-keys // TABLE_KEYS))

    counted = batches.mapInArrow(_sizes, "w long, t long").agg(F.sum("w").alias("w"), F.sum("t").alias("t")).first()
    n_words, n_pairs = tables(counted["w"] or 0), tables(counted["t"] or 0)

    def send_words(found):
        for b in found:
            for i in range(b.num_rows):
                one = b.slice(i, 1)
                batch = Batch.of(one, {})
                counts = np.bincount(batch.tokens[batch.train()], minlength=len(batch.words)).astype(np.uint32)
                yield from _send(one.column("batch")[0].as_py(), batch.words, n_words, counts).to_batches()

    words = stored(batches.mapInArrow(send_words, SENT).groupBy("part").applyInArrow(lambda rows: _answers(rows, 1, _count, True), BATCH))

    def send_pairs(rows):
        batch = Batch.of(rows, {1: np.uint64})
        keys, _, pair, _ = batch.pairs()
        counts = np.bincount(pair[batch.train()], minlength=len(keys)).astype(np.uint32)
        return _send(rows.column("batch")[0].as_py(), keys, n_pairs, counts)

    pairs = stored(batches.groupBy("batch").applyInArrow(send_pairs, SENT).groupBy("part").applyInArrow(lambda rows: _answers(rows, 2, _count, True), BATCH))
    model = Model.of(_counts(words), _counts(pairs))

    def send_histories(rows):
        batch = Batch.of(rows, {1: np.uint64, 2: np.uint64})
        keys, at, _, before = batch.pairs()
        known, told = (batch.told[1] >> np.uint64(1)).astype(np.int64), batch.told[2]
        r = (told >> np.uint64(1)).astype(np.int64)
        mine = ((told & np.uint64(1)) == 1) & (r > 0)
        h, w, r = before[at[mine]], batch.tokens[at[mine]], r[mine]
        freed = np.where(r <= DISCOUNTED, (1 - model.d2[np.minimum(r, DISCOUNTED + 1)]) * r, 0.0)
        n = len(batch.words)
        histories = _history_counts(batch, known)
        return _send(rows.column("batch")[0].as_py(), batch.words, n_words, np.bincount(h, freed, n), np.bincount(h, model.word(known[w]), n), histories.astype(np.uint64))

    def weigh(keys, rows):
        _, first, at = np.unique(keys, return_index=True, return_inverse=True)
        freed = np.bincount(at, _joined(rows, "x", np.float64), len(first))
        seen = np.bincount(at, _joined(rows, "y", np.float64), len(first))
        count = _joined(rows, "z", np.uint64)[first].astype(float)
        e = (freed <= 0) & (count > 0)
        alpha = np.where(count > 0, (freed + e) / np.maximum(count + e, 1) / (1 - seen), 1.0)
        return np.where(e, -alpha, alpha)[at], None  # the sign tells e

    known = batches.unionByName(words.filter("batch >= 0")).unionByName(pairs.filter("batch >= 0"))
    histories = stored(known.groupBy("batch").applyInArrow(send_histories, SENT).groupBy("part").applyInArrow(lambda rows: _answers(rows, 3, weigh, False), BATCH))

    def score(rows):
        import pyarrow as pa

        batch = Batch.of(rows, {1: np.uint64, 2: np.uint64, 3: np.float64})
        _, _, pair, before = batch.pairs()
        known = (batch.told[1] >> np.uint64(1)).astype(np.int64)
        r = (batch.told[2] >> np.uint64(1)).astype(np.int64)[pair]
        alpha = batch.told[3][before]
        count = _history_counts(batch, known)[before] + (alpha < 0)
        c = known[batch.tokens]
        p = np.where(r > 0, model.d2[np.minimum(r, DISCOUNTED + 1)] * r / np.maximum(count, 1), np.abs(alpha) * model.word(c))
        starts = np.cumsum(batch.lengths) - batch.lengths
        each = lambda x: np.add.reduceat(x, starts)
        ids = [None if none else int(i) for i, none, _ in batch.about]
        return pa.table({
            "doc_id": pa.array(ids, pa.int64()), "train": pa.array(batch.about[:, 2].astype(bool)), "n_tokens": pa.array(batch.lengths.astype(np.int64)),
            "n_known": pa.array(each((c > 0).astype(np.int64))), "train_tokens": pa.array([model.tokens] * len(ids), pa.int64()),
            "base_score": pa.array(each(np.log10((c + 1) / (model.tokens + model.types + 1)))), "score": pa.array(each(np.log10(p))),
        })

    out = known.unionByName(histories).groupBy("batch").applyInArrow(score, "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out


def _history_counts(batch: Batch, known: np.ndarray) -> np.ndarray:
    """How often each word is a history: its training count; the start: as often as the end is a token."""
    start, end = (np.searchsorted(batch.words, np.uint64(x)) for x in _marks())
    out = known.copy()
    out[start], out[end] = known[end], 0
    return out


def _sizes(found):
    import pyarrow as pa

    for b in found:
        w = [int.from_bytes(x[:8], "little") // 8 for x in b.column("a").to_pylist()]
        t = [int.from_bytes(x[:8], "little") // 4 for x in b.column("b").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(w, pa.int64()), pa.array(t, pa.int64())], ["w", "t"])


def op7_katz(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (fold(FOLDS) != HELD_OUT).alias("train"))
    out = katz_scores(docs)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op7_katz": op7_katz}
SQL: dict[str, str] = {}
