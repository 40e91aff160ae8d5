"""Language identification, words first: a word that training knows is scored by its log frequency in each language; one that it
doesn't know by its character n-grams, of the greatest length at which training knows any, averaged.

The model is a bounded table of words and n-grams with their log frequencies, learnt from a bounded sample of labelled
documents and sent to executors. A document's languages are compared by the sums over its words; scoring shuffles nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fold, slices, stored, table

FOLDS, HELD_OUT = 3, 1
SAMPLE = 5000  # labelled documents of a language that are learnt from, at most
TERMS = 300_000  # entries of the model, shared evenly by languages and lengths: the most frequent ones stay
LENGTHS = (5, 4, 3, 2, 1)
BROADCAST_LANGUAGES = 100_000  # a few megabytes; only the plan depends on it
KNOWN_WORDS, NEW_WORDS, CELLS = 200_000, 10_000, 1 << 20
NONE = "und"


class Words:
    """Texts to words: letters with the marks that belong to them, in lower case."""

    def __init__(self):
        import regex

        self.find = regex.compile(r"\p{L}[\p{L}\p{M}]*").findall

    def __call__(self, text: str | None) -> list[str]:
        return self.find((text or "").lower())


def grams(word: str, length: int) -> list[str]:
    """The n-grams of a word with a space at either end; repeats are kept, spaces alone are none."""
    padded = f" {word} "
    return [g for i in range(len(padded) - length + 1) if (g := padded[i : i + length]) != " "]


@dataclass(frozen=True)
class Model:
    """languages, ascending; for 0 (words) and each length the terms known, as rows of logs; what counts for a language without them."""

    languages: tuple[str, ...]
    terms: dict[int, dict[str, int]]
    logs: np.ndarray  # rows x languages

    @classmethod
    def of(cls, languages: list[str], counts, totals: dict[tuple[str, int], int]) -> "Model":
        """counts: (lang, length, term, n). A language that lacks a term counts as if the largest language had it half a time."""
        place = {x: k for k, x in enumerate(languages)}
        floors = {z: np.log(0.5 / max(1, *(n for (_, k), n in totals.items() if k == z))) for z in {k for _, k in totals}}
        terms: dict[int, dict[str, int]] = {z: {} for z in (0, *LENGTHS)}
        cells = []
        total = 0
        for lang, length, term, n in counts:
            row = terms[length].setdefault(term, total)
            total = max(total, row + 1)
            cells.append((row, place[lang], length, np.log(n / totals[lang, length])))
        logs = np.zeros((total, len(languages)))
        for row, _, length, _ in cells:
            logs[row] = floors[length]
        for row, k, _, v in cells:
            logs[row, k] = v
        return cls(tuple(languages), terms, logs)

    def of_words(self, words: list[str]) -> np.ndarray:
        """What each word adds to each language: nothing if not even one of its letters is known."""
        rows, sizes, whole = [], [], self.terms[0]
        for w in words:
            row = whole.get(w)
            if row is not None:
                rows.append(row)
                sizes.append(1)
                continue
            found = []
            for z in LENGTHS:
                known = self.terms[z]
                found = [known[g] for g in grams(w, z) if g in known]
                if found:
                    break
            rows += found
            sizes.append(len(found))
        out, counts = np.zeros((len(words), len(self.languages))), np.array(sizes, np.int64)
        some = counts > 0
        if rows:
            starts = (np.cumsum(counts) - counts)[some]
            out[some] = np.add.reduceat(self.logs[rows], starts, axis=0) / counts[some, None]
        return out


class Scorer:
    """Texts to (language, score). Remembers words, up to a fixed number."""

    def __init__(self, model: Model):
        self.model, self.words = model, Words()
        self.forget()

    def forget(self):
        self.known, self.rows = {}, np.zeros((1024, len(self.model.languages)))

    def places(self, words: list[str]) -> np.ndarray:
        if len(self.known) > KNOWN_WORDS:
            self.forget()
        known, first = self.known, len(self.known)
        new = list(dict.fromkeys(w for w in words if w not in known))
        while first + len(new) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        for i in range(0, len(new), NEW_WORDS):
            part = new[i : i + NEW_WORDS]
            self.rows[first + i : first + i + len(part)] = self.model.of_words(part)
        known.update(zip(new, range(first, first + len(new))))
        return np.array([known[w] for w in words], np.int64)

    def __call__(self, text: str | None) -> tuple[str, float]:
        words = self.words(text)
        if not words or not self.model.languages:
            return NONE, 0.0
        sums, step = np.zeros(len(self.model.languages)), max(1, min(KNOWN_WORDS, CELLS // len(self.model.languages)))
        for i in range(0, len(words), step):
            places = self.places(words[i : i + step])  # may grow rows
            sums += self.rows[places].sum(axis=0)
        odds = np.exp(sums - sums.max())
        best = int(np.argmax(odds))
        return self.model.languages[best], float(1 / odds.sum())


def sampled(docs: DataFrame, sample: int, lang: str = "lang") -> DataFrame:
    """lang, text of at most `sample` documents of each language, chosen by a hash of doc_id. Rows without lang are left out;
    of rows that share doc_id and lang the one of the least text counts, so those without doc_id are one document a language.
    Only ids and languages are ranked, and each task ranks its own first."""
    rows = docs.filter(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), "doc_id", "text", F.xxhash64("doc_id").alias("h"))
    first = W.partitionBy("lang").orderBy("h")
    ids = rows.select("lang", "h").distinct().withColumn("k", F.row_number().over(first)).filter(F.col("k") <= sample)
    upto = stored(ids.groupBy("lang").agg(F.max("h").alias("upto")))
    return rows.join(F.broadcast(upto) if upto.count() <= BROADCAST_LANGUAGES else upto, "lang").filter("h <= upto").groupBy("lang", "doc_id").agg(F.min("text").alias("text")).select("lang", "text")


def counted(docs: DataFrame) -> DataFrame:
    """lang, length, term, n of rows with lang and text: words (length 0), and n-grams of words."""

    def count(batches):
        from collections import Counter

        import pyarrow as pa

        words = Words()
        for one in (x for big in batches for x in slices(big)):
            counts = {}
            for lang, text in zip(one.column("lang").to_pylist(), one.column("text").to_pylist()):
                counts.setdefault(lang, Counter()).update(words(text))
            made = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "term", "n"])

    def cut(batches):
        import pyarrow as pa

        for one in batches:
            made = []
            for lang, word, n in zip(*(one.column(c).to_pylist() for c in ("lang", "term", "n"))):
                made += [(lang, z, g, n) for z in LENGTHS for g in grams(word, z)]
            for i in range(0, len(made), 1 << 17):
                part = made[i : i + (1 << 17)]
                yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in part], kind) for k, kind in enumerate((pa.string(), pa.int32(), pa.string(), pa.int64()))], ["lang", "length", "term", "n"])

    words = stored(docs.select("lang", "text").mapInArrow(count, "lang string, term string, n long").groupBy("lang", "term").agg(F.sum("n").alias("n")))
    parts = words.mapInArrow(cut, "lang string, length int, term string, n long").groupBy("lang", "length", "term").agg(F.sum("n").alias("n"))
    return words.select("lang", F.lit(0).alias("length"), "term", "n").unionByName(parts)


def train(docs: DataFrame, sample: int = SAMPLE, terms: int = TERMS, lang: str = "lang") -> Model:
    """The model of rows with doc_id, text and lang. Without labelled rows it knows no language; texts count whole."""
    counts = stored(counted(sampled(docs, sample, lang)))
    totals = {(r["lang"], r["length"]): r["n"] for r in counts.groupBy("lang", "length").agg(F.sum("n").alias("n")).collect()}
    languages = sorted({x for x, _ in totals})
    each = max(1, terms // max(1, len(languages) * (1 + len(LENGTHS))))
    order = W.partitionBy("lang", "length").orderBy(F.desc("n"), "term")
    kept = counts.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= each).drop("k")
    got = kept.toArrow()  # `terms` rows at most
    rows = sorted(zip(*(got.column(c).to_pylist() for c in ("lang", "length", "term", "n"))))
    return Model.of(languages, rows, totals)


def identified(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df with lang_pred and score; columns of these names are replaced. `und` and 0 for texts that are null or have no
    letter, and for all if the model knows no language. score is the share of the predicted language among the products of
    probabilities over words. Equal languages: the first by name. Texts of any length are scored whole."""
    from pyspark.sql import types as T

    df = df.drop("lang_pred", "score")
    told = df.sparkSession.sparkContext.broadcast(model)  # TERMS entries at most

    def score(batches):
        import pyarrow as pa

        of = Scorer(told.value)
        for one in (x for big in batches for x in slices(big, text)):
            got = [of(t) for t in one.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*one.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], [*one.schema.names, "lang_pred", "score"])

    return df.mapInArrow(score, T.StructType([*df.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def op12_langid(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(fold(FOLDS) != HELD_OUT).select("doc_id", "text", "lang"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (fold(FOLDS) == HELD_OUT).alias("held_out"))
    return identified(rows, model).drop("text")


QUERIES = {"op12_langid": op12_langid}
SQL: dict[str, str] = {}
