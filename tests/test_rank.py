import datetime

import pytest
from pyspark.sql import functions as F

from menurank import constants as C
from menurank.operators import kmeans, report, tfidf
from menurank.operators.recommend import Profile, batch, excluded, recommend, scored, what_if
from menurank.schemas import CLEAN
from pyspark.sql import types as T

# The four-row fixture.
MEALS = [
    (21, ["토마토파스타", "크림스프", "샐러드"], [5, 6, 10], 760.0, 110.0, 32.0, 20.0),
    (22, ["매운불닭덮밥", "미역국", "김치"], [1, 2, 5, 6, 10, 16], 930.0, 140.0, 40.0, 29.0),
    (23, ["해물짬뽕", "군만두", "단무지"], [5, 6, 9, 17], 850.0, 125.0, 35.0, 25.0),
    (24, ["비빔밥", "된장국", "바나나"], [1, 5, 6], 620.0, 95.0, 22.0, 14.0),
]


def table(spark, rows=MEALS):
    data = [(d, datetime.date(2026, 7, d), "학교", "중식", dishes, " ".join(dishes), codes, cal, carb, pro, fat, len(dishes)) for d, dishes, codes, cal, carb, pro, fat in rows]
    return spark.createDataFrame(data, T.StructType([T.StructField("row_id", T.LongType()), *CLEAN.fields]))


def test_neutral_profile_scores_exactly_the_base(spark):
    got = recommend(table(spark), "row_id", Profile(spice_level=2), 4).collect()
    assert max(r["score"] for r in got) == 20.0 and all(0 <= r["score"] <= 100 for r in got)


def test_excluded_codes_never_come_back(spark):
    rows, profile = table(spark), Profile(allergy_codes=(9,))
    assert excluded(rows, profile) == 1
    got = recommend(rows, "row_id", profile, 10).collect()
    assert len(got) == 3 and not any(9 in r["allergy_codes"] for r in got)


def test_all_excluded_keeps_columns_and_says_so(spark):
    got = recommend(table(spark), "row_id", Profile(allergy_codes=(5,)))
    assert got.count() == 0 and {"score", "reason", "cluster_name", "safety_notice"} <= set(got.columns)
    summary, shown = report.run_recommendation(table(spark), "row_id", allergy_codes=[5])
    assert summary.startswith("선택한") and "4" in summary and shown.columns == C.RESULT_COLUMNS and shown.count() == 0


def test_avoided_terms_lower_scores_and_are_named(spark):
    before = {r["row_id"]: r for r in scored(table(spark), "row_id", Profile(("파스타",), spice_level=2)).collect()}
    after = {r["row_id"]: r for r in scored(table(spark), "row_id", Profile(("파스타",), ("스프",), spice_level=2)).collect()}
    assert all(after[k]["score"] <= before[k]["score"] for k in before)
    assert after[21]["score"] < before[21]["score"] and "피하고 싶은 키워드: 스프" in after[21]["reason"]


def test_result_table(spark):
    summary, shown = report.run_recommendation(table(spark), "row_id", likes_text="파스타, 피자", preferred_types=["면"], top=2)
    got = shown.collect()
    assert shown.columns == C.RESULT_COLUMNS and [r[0] for r in got] == [1, 2] and got[0][1] == "2026-07-21" and got[0][6] == "5, 6, 10"
    assert "2개" in summary


def test_clusters(spark):
    got = {r["row_id"]: r["cluster_name"] for r in kmeans.labelled(table(spark), "row_id").collect()}
    assert got[24] == C.LIGHT and got[22] == C.HEARTY
    few = lambda rows: {r["cluster_name"] for r in kmeans.labelled(table(spark, rows), "row_id").collect()}
    assert few(MEALS[:2]) == {C.TOO_FEW}
    assert few([(*m[:3], None, None, None, None) for m in MEALS]) == {C.TOO_FEW}
    assert few([*MEALS[:2], *[(*m[:3], None, None, None, None) for m in MEALS[2:]]]) == {C.TOO_FEW}
    assert few([(d, *MEALS[0][1:]) for d in (1, 2, 3)]) == {C.MIDDLE}


def test_order_statistics_without_a_global_sort(spark, monkeypatch):
    monkeypatch.setattr(kmeans, "MOST_AT_ONCE", 50)
    rows = spark.range(3000).select(((F.col("id") * 7919) % 1000).cast("double").alias("c"), F.col("id").alias("k"))
    want = sorted((r["c"], r["k"]) for r in rows.collect())
    got = kmeans.at_positions(rows, ["c", "k"], [0, 1500, 2999])
    assert [(r["c"], r["k"]) for r in got] == [want[0], want[1500], want[2999]]


def test_similarity_of_blank_and_foreign_queries(spark):
    rows = table(spark)
    assert {r["similarity"] for r in tfidf.similarity(rows, "row_id", "menu_text", "  ").collect()} == {0.0}
    assert {r["similarity"] for r in tfidf.similarity(rows, "row_id", "menu_text", "zzz").collect()} == {0.0}


def test_small_corpus_goldens(spark):
    docs = spark.createDataFrame([(1, "파스타 피자"), (2, "파스타"), (3, "밥 국")], "k int, t string")
    from menurank.functions import text as X

    got = {(r["k"], r["term"]): r for r in tfidf.tfidf(tfidf.term_counts(docs, "k", X.char_grams(F.col("t"))), "k", 3).collect()}
    assert round(got[1, "파스"]["idf"], 6) == 1.287682 and round(got[1, "피자"]["idf"], 6) == 1.693147 and round(got[1, "피자"]["tfidf"], 6) == 0.112876


@pytest.mark.parametrize("bad", [Profile(tuple("abcdef")), Profile(spice_level=6), Profile(preferred_types=("x",)), Profile(allergy_codes=(20,))])
def test_limits_of_profiles(bad):
    with pytest.raises(ValueError):
        bad.validated()
    assert Profile((" a", "a ", "")).validated().likes == ("a",)


def test_missing_columns_and_top(spark):
    with pytest.raises(ValueError, match="allergy_codes, date"):
        recommend(spark.createDataFrame([(1, "x")], "row_id int, menu_text string"), "row_id", Profile())
    with pytest.raises(ValueError):
        recommend(table(spark), "row_id", Profile(), 0)


def test_batch_agrees_with_single_profiles(spark):
    profiles = {"a": Profile(("파스타",), preferred_types=("면",), spice_level=3), "b": Profile(("밥",), allergy_codes=(9,))}
    both = batch(table(spark), "row_id", profiles, 2).collect()
    for name, p in profiles.items():
        alone = recommend(table(spark), "row_id", p, 2).collect()
        assert [r["row_id"] for r in sorted((r for r in both if r["profile"] == name), key=lambda r: r["rank"])] == [r["row_id"] for r in alone]
    assert {r["profile"] for r in what_if(table(spark), "row_id", profiles["a"], spice_level=5).collect()} == {"before", "after"}


def test_input_order_changes_nothing(spark):
    p = Profile(("파스타",))
    assert recommend(table(spark), "row_id", p, 4).collect() == recommend(table(spark, MEALS[::-1]), "row_id", p, 4).collect()


def test_selection_where_one_value_fills_most_rows(spark, monkeypatch):
    monkeypatch.setattr(kmeans, "MOST_AT_ONCE", 60)
    monkeypatch.setattr(kmeans, "SAMPLE", 40)
    rows = spark.range(4000).select(F.when(F.col("id") % 10 == 0, F.col("id") % 7).otherwise(5).cast("double").alias("c"), ((F.col("id") * 2741) % 4001).alias("k"))
    want = sorted((r["c"], r["k"]) for r in rows.collect())
    places = [0, 1, 399, 400, 1999, 2000, 3600, 3998, 3999]
    assert [(r["c"], r["k"]) for r in kmeans.at_positions(rows, ["c", "k"], places)] == [want[p] for p in places]
    named = rows.select(F.lit("same").alias("c"), F.concat(F.lit("key"), "k").alias("k"))  # texts, and a single value
    got = kmeans.at_positions(named, ["c", "k"], [0, 2222])
    assert [r["k"] for r in got] == [sorted(f"key{k}" for _, k in want)[p] for p in (0, 2222)]


@pytest.mark.parametrize("small", [0, 100_000])
def test_groups_are_fitted_as_if_alone(spark, monkeypatch, small):
    """Also with a job for each round."""
    monkeypatch.setattr(kmeans, "SMALL", small)
    rows = spark.range(300).select(F.col("id").alias("row_id"), *((F.col("id") * m % 97).cast("double").alias(c) for m, c in zip((7, 11, 13, 17, 3), kmeans.FEATURES)))
    rows = rows.withColumn("calories", F.when(F.col("row_id") % 9 != 0, F.col("calories"))).withColumn("fat_g", F.when(F.col("row_id") % 8 != 0, F.col("fat_g")))
    groups = [F.lit(True), F.col("row_id") % 3 == 0, F.col("row_id") < 2, F.col("row_id") > 1000, F.col("row_id") % 9 == 0]
    for group, fit in zip(groups, kmeans.fitted(rows, "row_id", groups), strict=True):
        own = rows.filter(group)
        alone = {r["row_id"]: r["cluster_name"] for r in kmeans.labelled(own, "row_id").collect()}
        assert {r["row_id"]: r["n"] for r in own.select("row_id", fit.name().alias("n")).collect()} == alone
    assert len(set(alone.values())) == 1
    other = kmeans.fitted(rows, "row_id", groups)
    monkeypatch.setattr(kmeans, "SMALL", 100_000 - small)
    for a, b in zip(other, kmeans.fitted(rows, "row_id", groups), strict=True):
        assert a.names == b.names and all(abs(x - y) < 1e-9 for c, d in zip(a.centroids, b.centroids, strict=True) for x, y in zip(c, d, strict=True))


def test_profiles_as_a_table_in_blocks(spark, monkeypatch):
    from menurank.operators import recommend as R

    profiles = {f"p{i}": Profile(("파스타",) if i % 2 else ("밥", "국"), spice_level=1 + i % 5, allergy_codes=(9,) if i % 3 else ()) for i in range(7)}
    rows = [(n, list(p.likes), None, None, p.spice_level, list(p.allergy_codes) or None) for n, p in profiles.items()]
    given = spark.createDataFrame(rows, "profile string, likes array<string>, avoids array<string>, preferred_types array<string>, spice_level int, allergy_codes array<int>")
    whole = [(r["profile"], r["rank"], r["row_id"], r["score"], r["cluster_name"]) for r in batch(table(spark), "row_id", given, 2).collect()]
    monkeypatch.setattr(R, "AT_ONCE", 3)
    assert sorted((r["profile"], r["rank"], r["row_id"], r["score"], r["cluster_name"]) for r in batch(table(spark), "row_id", given, 2).collect()) == sorted(whole)
    assert len(whole) == 14
    with pytest.raises(ValueError):
        batch(table(spark), "row_id", given.union(given), 2)
    bad = given.withColumn("likes", F.when(F.col("profile") == "p1", F.lit(list("abcdef"))).otherwise(F.col("likes")))
    assert [tuple(r) for r in R.profile_faults(bad).collect()] == [("p1", "terms")]


@pytest.mark.parametrize("cells", [0, 10**9])
def test_similarity_with_and_without_a_broadcast(spark, monkeypatch, cells):
    monkeypatch.setattr(tfidf, "BROADCAST_CELLS", cells)
    got = {r["row_id"]: round(r["similarity"], 9) for r in tfidf.similarity(table(spark), "row_id", "menu_text", "비빔밥 파스타").collect()}
    texts = {m[0]: " ".join(m[1]) for m in MEALS}

    def grams(t):
        return [p[i : i + z] for w in t.split() for p in [f" {w} "] for z in (2, 3, 4) for i in range(len(p) - z + 1)]

    import math
    from collections import Counter

    vectors = {k: Counter(grams(t)) for k, t in {**texts, None: "비빔밥 파스타"}.items()}
    df = Counter(g for v in vectors.values() for g in v)
    weigh = {k: {g: n * (math.log((1 + len(vectors)) / (1 + df[g])) + 1) for g, n in v.items()} for k, v in vectors.items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    q = weigh.pop(None)
    assert got == {k: round(sum(x * q.get(g, 0) for g, x in v.items()) / norm(v) / norm(q), 9) for k, v in weigh.items()}


def test_nothing_stays_cached(spark):
    spark.catalog.clearCache()
    recommend(table(spark), "row_id", Profile(("파스타",)), 2).collect()
    report.run_recommendation(table(spark), "row_id", top=2)[1].collect()
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_positional_zip(spark):
    from menurank.operators.zipping import numbered, zipped

    left = spark.range(1000).select(((F.col("id") * 7) % 1000).alias("a"))
    right = spark.range(400).select((1000 - F.col("id")).alias("b"), F.lit("x").alias("t"))
    rows, n = numbered(left.repartition(7), ["a"])
    assert n == 1000 and all(r["a"] == r["position"] for r in rows.collect())
    got = zipped(left, ["a"], right, ["b"]).collect()
    assert len(got) == 400 and all(r["a"] == r["position"] and r["b"] == 601 + r["position"] for r in got)
    with pytest.raises(ValueError, match="1000 rows beside 400"):
        zipped(left, ["a"], right, ["b"], strict=True)
    with pytest.raises(ValueError, match="a"):
        zipped(left, ["a"], left, ["a"])
    assert zipped(left.limit(0), ["a"], right, ["b"], name="p").count() == 0
    assert "Window" not in rows._jdf.queryExecution().executedPlan().toString()
