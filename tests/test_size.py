"""What keeps work in bounds as tables grow."""

import random
import re

import pytest
from pyspark.sql import functions as F

from menurank.functions import text as X
from menurank.operators import kmeans, ngrams, recommend, report, tfidf
from menurank.plans import meals_view

RULES = recommend.Rules(types={"a": ["bolt"], "b": ["gear"]}, spice={5: ["hot"]})


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def meals(spark, n=400):
    r = random.Random(3)
    words = ["bolt", "gear", "hot", "red", "ring", "비빔밥", "ß", "x"]
    rows = [(i, f"2026-01-{i % 28 + 1:02}", " ".join(r.choices(words, k=r.randrange(0, 6))), [r.randrange(1, 20)], *(float(r.randrange(50)) for _ in range(4)), 3) for i in range(n)]
    return spark.createDataFrame(rows, "row_id long, date string, menu_text string, allergy_codes array<int>, calories double, carbs_g double, protein_g double, fat_g double, dish_count int").withColumn("date", F.col("date").cast("date"))


def test_similarities_shuffle_nothing_and_are_those_of_the_join(spark, monkeypatch):
    docs = meals(spark)
    ask = lambda: tfidf.with_similarities(docs, "row_id", "menu_text", ["bolt 비빔밥 bolt", " ", "SS zebra"], [0, 0, 1], [F.lit(True), F.col("row_id") % 3 > 0], [400, 266])
    near = lambda df: {r["row_id"]: [round(v, 10) for v in r["_similarities"]] for r in df.collect()}
    here = ask()
    assert "Exchange" not in plan(here)
    got = near(here)
    monkeypatch.setattr(tfidf, "LOCAL_TERMS", 0)
    assert got == near(ask()) and len(got) == 400 and any(v[0] > 0 for v in got.values()) and any(v[2] > 0 for v in got.values())
    for name in ("SLICE", "MOST"):  # in this process: tasks have their own copy
        monkeypatch.setattr(ngrams, name, 5)
    texts = [r["t"] for r in docs.select(X.spaced_words(F.col("menu_text")).alias("t")).collect()]
    assert [s for part in ngrams.slices(texts) for s in texts[part]] == texts


def test_tasks_without_rows_or_words_have_no_ngrams(spark, tmp_path):
    """A file with one row group in several splits, of which all but one are empty; tasks of blank texts; a table without rows."""
    texts = spark.range(300).select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("red bolt "), F.col("id") % 7)).otherwise(F.lit(" ")).alias("menu_text"))
    near = lambda df: {r["row_id"]: round(r["similarity"], 10) for r in tfidf.similarity(df, "row_id", "menu_text", "bolt gear").collect()}
    want, path = near(texts.coalesce(1)), str(tmp_path / "one.parquet")
    assert len(want) == 300 and want[0] == 0 < want[1]
    texts.coalesce(1).write.parquet(path)
    usual = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in usual:
            spark.conf.set(k, "500")
        split = spark.read.parquet(path)
        assert split.rdd.getNumPartitions() > 2 and near(split) == want
    finally:
        for k, v in usual.items():
            spark.conf.set(k, v)
    blank = texts.filter("row_id % 3 = 0")
    assert near(blank.repartition(3).union(texts.filter("row_id % 3 > 0"))) == want
    assert near(blank) == dict.fromkeys(range(0, 300, 3), 0.0) and near(texts.filter("row_id < 0").repartition(2)) == {}


def test_only_rows_that_may_be_best_are_ranked(spark):
    """Each profile's best rows are those of all rows scored and sorted; equal scores at the cut, sets and few safe rows too."""
    profiles = {"p": recommend.Profile(("bolt",), ("ring",), ("a",), 5, (3,)), "q": recommend.Profile(spice_level=2), "r": recommend.Profile(("gear", "red"), (), (), 1, tuple(range(1, 20)))}
    for top in (1, 7, 1000):
        made = recommend.Ranking(meals(spark), "row_id", profiles, RULES)
        rows = made.scored().select("profile", "row_id", "score", "date").collect()
        want = {(p, k): r["row_id"] for p in profiles for k, r in enumerate(sorted((r for r in rows if r["profile"] == p), key=lambda r: (-r["score"], r["date"], r["row_id"]))[:top], 1)}
        best = made.best(top)
        assert {(r["profile"], r["rank"]): r["row_id"] for r in best.collect()} == want
    near = made.near()
    tenths = near.select("row_id", F.posexplode(F.array(*made.tenths(near))).alias("j", "t")).filter("t is not null")
    far = made.scored().join(tenths, ["row_id"]).filter("_j = j").agg(F.max(F.abs(F.col("score") * 10 - F.col("t"))).alias("d"), F.count("*").alias("n")).first()
    assert far["n"] == len(rows) and far["d"] <= 1.0001


def test_selection_samples_without_a_sort_and_pins_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(kmeans, "MOST_AT_ONCE", 60)
    monkeypatch.setattr(kmeans, "SAMPLE", 40)
    rows = spark.range(3000).select((F.when(F.col("id") < 2500, 7.0).otherwise(F.col("id"))).alias("v"))
    assert [r["v"] for r in kmeans.at_positions(rows, ["v"], [0, 1200, 2499, 2500, 2999])] == [7.0, 7.0, 7.0, 2500.0, 2999.0]


def test_quartiles_are_percentiles(spark, monkeypatch):
    monkeypatch.setattr(kmeans, "MOST_AT_ONCE", 50)
    rows = spark.range(1003).select((F.col("id") * 37 % 501 / 7).alias("a"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("b"), F.lit(None).cast("double").alias("c"), F.lit(2.5).alias("d"))
    got = {r["column"]: (r["q1"], r["q2"], r["q3"]) for r in report.described(rows, ["a", "b", "c", "d"]).collect()}
    for c in "abcd":
        assert got[c] == tuple(rows.agg(*(F.round(F.expr(f"percentile({c}, {q})"), 1) for q in (0.25, 0.5, 0.75))).first())
    assert "percentile" not in plan(report.described(rows, ["a"]))


def test_terms_are_counted_inside_rows(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b"), (3, ""), (4, None)], "k int, t string")
    words = F.split("t", " ")
    count = lambda d: sorted((r["k"], r["term"], r["n"]) for r in tfidf.term_counts(d, "k", words).collect())
    assert "Exchange" not in plan(tfidf.term_counts(docs, "k", words))
    assert count(docs) == [(1, "a", 2), (1, "b", 1), (2, "b", 1), (3, "", 1)]
    assert count(docs.union(docs.limit(1))) == [(1, "a", 4), (1, "b", 2), (2, "b", 1), (3, "", 1)]
    twice = tfidf.tfidf_of(docs.union(docs.limit(1)), "k", words, 4).filter("k = 1 and term = 'a'").first()
    assert (twice["n"], twice["df"]) == (4, 1) and abs(twice["tf"] - 4 / 6) < 1e-12


@pytest.mark.parametrize("text", ["a  b", "a b\n", " a b (1.2) ", "a b", " a b", "비빔밥 (1) ", "a (1) b", "é b", "(1.2)", "a\x1cb", "a&nbsp;b "])
def test_dishes_by_the_short_way_too(spark, text):
    import re

    want = " ".join(re.sub(r"\([0-9]{1,2}(?:\.[0-9]{1,2})*\)", "", text.replace("&nbsp;", " ")).split())
    got = spark.createDataFrame([(text,)], "t string").select(X.dishes(F.col("t")).alias("d")).first()["d"]
    assert got == ([want] if want else [])


def test_cleaning_makes_dishes_once(spark):
    from menurank.operators.clean import cleaned

    raw = spark.createDataFrame([(1, "20260101", "a<br/>b (1)")], "row_id long, MLSV_YMD string, DDISH_NM string")
    assert plan(cleaned(raw, ("row_id",))).count("<br") == 1
    dates = spark.createDataFrame([(d,) for d in ("20260101", "20260101\n", "20261301", "20260230", "2026111")], "t string")
    assert [str(r[0]) for r in dates.select(X.compact_date(F.col("t"))).collect()][:5] == ["2026-01-01", "2026-01-01", "None", "None", "2026-11-01"]


def test_tasks_of_the_meals_joins_are_as_many_as_lines_need(spark, monkeypatch):
    """More tasks than the session's shuffle partitions where the lines need them, in every join, and the same meals."""
    sf, usual = "/root/testdata/sf0.001", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    dealt = lambda df: {int(n) for n in re.findall(r"hashpartitioning\([lopc]_(?:part|order|cust)key#\w+, (\d+)\)", plan(df))}
    want = sorted(meals_view.raw_meals(spark, sf).collect())
    monkeypatch.setattr(meals_view, "LINES", 500)
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1k")  # as if part and customer were large
    try:
        made = meals_view.raw_meals(spark, sf)
        assert dealt(made) == {-(-lines // 500)} and lines > 4 * 500
        assert sorted(made.collect()) == want
        monkeypatch.setattr(meals_view, "LINES", lines)
        assert dealt(meals_view.raw_meals(spark, sf)) == {4}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
