"""TF-IDF over character n-grams or words, as relations (document, term, count)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from . import ngrams
from .steps import written


def _counted(docs: DataFrame, key: str, terms) -> tuple[DataFrame, bool]:
    """key, term, n, total: counted inside rows of docs; and whether no two rows share a key."""
    most = docs.groupBy(key).count().agg(F.max("count")).first()[0] or 0
    rows = docs.select(key, F.sort_array(terms).alias("terms"))
    rows = rows.select(key, F.size("terms").cast("bigint").alias("total"), F.explode(X.runs("terms")).alias("one"))
    return rows.select(key, "one.term", F.col("one.n").cast("bigint").alias("n"), "total"), most <= 1


def term_counts(docs: DataFrame, key: str, terms) -> DataFrame:
    """key, term, n: how often each term of the array `terms` occurs in each document. Terms are counted inside rows, and only
    where rows share a key are counts shuffled."""
    rows, single = _counted(docs, key, terms)
    return rows.drop("total") if single else rows.groupBy(key, "term").agg(F.sum("n").alias("n"))


def document_frequency(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.count("*").alias("df"))


def idf(df, corpus):
    return F.log((1 + corpus) / (1 + df)) + 1.0


def tfidf(counts: DataFrame, key: str, corpus: int) -> DataFrame:
    """key, term, n, df, tf, idf, tfidf: shares of a document's terms times smoothed inverse document frequency."""
    if "total" not in counts.columns:
        counts = counts.withColumn("total", F.sum("n").over(W.partitionBy(key)))
    known = written(document_frequency(counts))
    if known.count() <= BROADCAST_TERMS:
        known = F.broadcast(known)
    out = counts.withColumn("tf", F.col("n") / F.col("total")).drop("total").join(known, "term")
    return out.withColumn("idf", idf(F.col("df"), F.lit(corpus))).withColumn("tfidf", F.col("tf") * F.col("idf"))


def tfidf_of(docs: DataFrame, key: str, terms, corpus: int) -> DataFrame:
    """tfidf of the array `terms`; rows of terms are shuffled only if the vocabulary is large, or rows share a key."""
    rows, single = _counted(docs, key, terms)
    return tfidf(rows if single else rows.groupBy(key, "term").agg(F.sum("n").alias("n")), key, corpus)


# Only the plan depends on these, not the result: n-grams that each task may hold, and numbers for them (32 MB or so).
LOCAL_TERMS, BROADCAST_CELLS, BROADCAST_TERMS = 200_000, 4_000_000, 1_000_000


def with_similarities(docs: DataFrame, key: str, text: str, queries: list[str], of: list[int], groups: list[Column], corpora: list[int]) -> DataFrame:
    """docs with _similarities (one for each query): cosines of character n-gram vectors with queries. Query j is compared within
    group of[j], the rows where that condition holds (corpora[i] of them), and counts as a document there.

    Terms' shares cancel in the cosine, so counts serve. A blank query gives zeros. One pass over docs makes document
    frequencies for all groups, a row of a task and n-gram. Then cosines are made where the rows are: nothing is shuffled
    while tasks can hold the vocabulary, else rows of n-grams are joined with it. key must be unique."""
    asked = [j for j, q in enumerate(queries) if q.strip()]
    if not asked:
        return docs.withColumn("_similarities", F.array(*(F.lit(0.0) for _ in queries)))
    spark, used = docs.sparkSession, sorted({of[j] for j in asked})
    flags = [F.coalesce(groups[i], F.lit(False)).alias(f"g{k}") for k, i in enumerate(used)]
    parts = docs.select(X.spaced_words(F.col(text)).alias("text"), *flags).mapInPandas(ngrams.frequencies(len(used)), "term string, " + ", ".join(f"d{k} long" for k in range(len(used))))
    known = written(parts.groupBy("term").agg(*(F.sum(f"d{k}").alias(f"d{i}") for k, i in enumerate(used))))
    texts = spark.createDataFrame([(j, queries[j]) for j in asked], "j int, q string")
    terms = texts.select("j", F.explode(X.char_grams(F.col("q"))).alias("term")).groupBy("term").agg(*(F.count_if(F.col("j") == j).alias(f"q{j}") for j in asked))
    told = terms.join(known, "term", "left").collect()  # the terms of the queries
    norms = {}
    for j in asked:
        own = [(r[f"q{j}"], r[f"d{of[j]}"] or 0) for r in told if r[f"q{j}"]]
        norms[j] = math.sqrt(sum((q * (math.log((2 + corpora[of[j]]) / (2 + d)) + 1.0)) ** 2 for q, d in own)) or 1.0
    many = known.count()
    if many <= LOCAL_TERMS and many * len(asked) <= BROADCAST_CELLS:
        return docs.withColumn("_similarities", _local(known, told, asked, queries, of, corpora, norms)(X.spaced_words(F.col(text))))
    shared = lambda j, d, q: idf(d + F.least(q, F.lit(1)), F.lit(corpora[of[j]] + 1))
    queried = spark.createDataFrame([(r["term"], *(r[f"q{j}"] for j in asked)) for r in told], "term string, " + ", ".join(f"q{j} long" for j in asked))
    weights = known.join(F.broadcast(queried), "term", "left")
    count = {j: F.coalesce(f"q{j}", F.lit(0)) for j in asked}
    weights = weights.select("term", *(shared(j, F.col(f"d{of[j]}"), count[j]).alias(f"i{j}") for j in asked), *(count[j].alias(f"q{j}") for j in asked))
    counts = docs.select(key, F.sort_array(X.char_grams(F.col(text))).alias("grams")).select(key, F.explode(X.runs("grams")).alias("one")).select(key, "one.term", "one.n")
    sums = counts.join(weights, "term").groupBy(key).agg(*(x for j in asked for x in (
        F.sum(F.col("n") * F.col(f"i{j}") * F.col(f"q{j}") * F.col(f"i{j}")).alias(f"p{j}"), F.sum((F.col("n") * F.col(f"i{j}")) ** 2).alias(f"s{j}"),
    )))
    cosine = {j: F.coalesce(F.col(f"p{j}") / (F.when(F.col(f"s{j}") == 0, 1.0).otherwise(F.sqrt(f"s{j}")) * norms[j]), F.lit(0.0)) for j in asked}
    near = written(sums.select(key, F.array(*(cosine.get(j, F.lit(0.0)) for j in range(len(queries)))).alias("_similarities")))
    return docs.join(near, key, "left").withColumn("_similarities", F.coalesce("_similarities", F.array(*(F.lit(0.0) for _ in queries))))


def _local(known: DataFrame, told: list, asked: list[int], queries: list[str], of: list[int], corpora: list[int], norms: dict):
    """A UDF over spaced words for vocabularies that tasks can hold: at most LOCAL_TERMS."""
    table = known.orderBy("term").toPandas()
    terms, place = table["term"].tolist(), {t: i for i, t in enumerate(table["term"])}
    weights, counts = [], []
    for j in range(len(queries)):
        q = np.zeros(len(terms))
        for r in told if j in asked else ():
            if r["term"] in place:
                q[place[r["term"]]] = r[f"q{j}"]
        counts.append(q)
        weights.append(np.log((2 + corpora[of[j]]) / (1 + table[f"d{of[j]}"].to_numpy(float) + np.minimum(q, 1))) + 1.0 if j in asked else q)
    return F.pandas_udf(ngrams.cosines(terms, weights, counts, [norms.get(j, 1.0) for j in range(len(queries))]), "array<double>")


def similarity(docs: DataFrame, key: str, text: str, query: str) -> DataFrame:
    """key, similarity for each document: cosine of character n-gram vectors with one query (see `with_similarities`)."""
    corpus = docs.count() if query.strip() else 0
    return with_similarities(docs.select(key, text), key, text, [query], [0], [F.lit(True)], [corpus]).select(key, F.get("_similarities", F.lit(0)).alias("similarity"))


def keywords(docs: DataFrame, key: str, words, stop: list[str], top: int = 8) -> DataFrame:
    """key, rank, term, n, df, tfidf: each document's `top` terms by TF-IDF (to 6 digits), ties by term."""
    corpus = docs.count()
    kept = F.filter(words, lambda w: ~w.isin(stop)) if stop else words
    scored = tfidf_of(docs, key, kept, corpus).withColumn("tfidf", F.round("tfidf", 6))
    order = W.partitionBy(key).orderBy(F.desc("tfidf"), "term")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select(key, "rank", "term", "n", "df", "tfidf")


def most_similar(docs: DataFrame, key: str, text: str, query: str) -> DataFrame:
    """The document most similar to the query; ties to the least key."""
    return similarity(docs, key, text, query).withColumn("similarity", F.round("similarity", 6)).orderBy(F.desc("similarity"), key).limit(1)
