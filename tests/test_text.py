import html
import random

import pytest
from pyspark.sql import functions as F

from menurank.constants import CLEAN_COLUMNS
from menurank.functions import text as X
from menurank.functions.rounding import fixed2, round1
from menurank.operators.clean import cleaned, in_range
from menurank.sources.files import from_rows


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


def test_dishes_decode_before_they_split(spark):
    raw = "soup (4)&lt;BR&gt;rye&nbsp;bread<br  />green\t peas (7.11)<br>(2)&lt;br/&gt; "
    assert one(spark, X.dishes(F.col("t")), t=raw) == ["soup", "rye bread", "green peas"]


def test_a_bad_code_spoils_its_group_but_its_text_goes(spark):
    assert one(spark, X.codes(F.col("t")), t="stew (18.3)<br/>tea (3.9)pie (4.77.8) egg (00)") == [3, 9, 18]
    assert one(spark, X.dishes(F.col("t")), t="pie (4.77.8)") == ["pie"]
    assert one(spark, X.codes(F.col("t")), t="half a litre (500) (5,6) (.7) 8") == []


def test_entities_as_the_standard_library_decodes_them(spark):
    texts = ["&amp;lt;", "&#44032;&#x41;", "&middot;&copy;&hellip;", "a & b", "&;", "&unknown; &", "&#128;&#0;&#xD800;&#1114112;", "", "no"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", X.decoded(F.col("t")).alias("x")).orderBy("i").collect()
    assert [r["x"] for r in got] == [html.unescape(t).strip() for t in texts]


def test_numbers_and_nutrients(spark):
    assert [one(spark, X.first_number(F.col("t")), t=t) for t in ("about -12.5 of 80", "none", "", "3.")] == [-12.5, None, None, 3.0]
    raw = "지방(g): 7<br/>단백질  (g) :-0.25<br/>탄수화물(mg) : 9"
    assert [one(spark, X.nutrient(F.col("t"), n), t=raw) for n in ("carbs_g", "protein_g", "fat_g")] == [None, -0.25, 7.0]


@pytest.mark.parametrize(("text", "day"), [("20260724", "2026-07-24"), (" 20260724 ", "2026-07-24"), ("2026724", "2026-07-24"), ("202672", "2026-07-02"), ("20260230", None), ("2026-07-24", None), ("", None), (None, None)])
def test_dates(spark, text, day):
    assert str(one(spark, X.compact_date(F.col("t")), t=text)) == str(day)


def test_grams_of_short_words_and_wide_spaces(spark):
    got = one(spark, X.char_grams(F.col("t")), t="파스타　a")
    assert [g for g in got if len(g) == 2] == [" 파", "파스", "스타", "타 ", " a", "a "]
    assert [g for g in got if len(g) == 4 and "a" in g] == []


def test_rounding_is_pythons(spark):
    rng = random.Random(3)
    values = [0.25, 0.35, 14.45, 0.05, 0.15, 2.675, 0.125, 0.0, 100.0] + [rng.randrange(0, 200_000) / 2000 for _ in range(4000)] + [rng.random() for _ in range(2000)]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", round1(F.col("v")).alias("a"), fixed2(F.col("v")).alias("b")).collect()
    assert [r["a"] for r in got] == [round(r["v"], 1) for r in got]
    assert [r["b"] for r in got] == [f"{r['v']:.2f}" for r in got]


def test_cleaned_table(spark):
    rows = [{"MLSV_YMD": "20260724", "DDISH_NM": "밥 (1)<br/>국", "CAL_INFO": "10 Kcal", "SCHUL_NM": " 학교 "}, {"MLSV_YMD": "bad", "DDISH_NM": "밥"}, {"MLSV_YMD": "20260724", "DDISH_NM": " "}, {"MLSV_YMD": "20260725"}]
    got = cleaned(from_rows(spark, rows))
    assert got.columns == CLEAN_COLUMNS
    (row,) = got.collect()
    assert (str(row["date"]), row["school_name"], row["meal_type"], row["dishes"], row["menu_text"], row["allergy_codes"], row["calories"], row["carbs_g"], row["dish_count"]) == ("2026-07-24", "학교", "", ["밥", "국"], "밥 국", [1], 10.0, None, 2)
    assert cleaned(from_rows(spark, [])).columns == CLEAN_COLUMNS
    assert in_range(from_rows(spark, rows), "20260724", "20260724").count() == 2


def test_cleaning_needs_no_python_and_no_shuffle(spark):
    plan = cleaned(from_rows(spark, []))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_a_date_range_reaches_the_scan(spark, tmp_path):
    raw = from_rows(spark, [{"MLSV_YMD": d} for d in ("20260101", "20260215", None, "")])
    raw.write.parquet(str(tmp_path / "raw"))
    rows = in_range(spark.read.parquet(str(tmp_path / "raw")), "20260101", "20260131")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(MLSV_YMD,20260101)" in plan and "LessThanOrEqual(MLSV_YMD,20260131)" in plan and rows.count() == 1
    assert in_range(raw, "", "20260131").count() == 3  # a missing date counts as the empty text


def test_counts_inside_a_row(spark):
    rows = spark.createDataFrame([(["a", "a", "b"],), ([],), (["x"],), (None,)], "g array<string>")
    got = [r["r"] if r["r"] is None else [(x["term"], x["n"]) for x in r["r"]] for r in rows.select(X.runs("g").alias("r")).collect()]
    assert got == [[("a", 2), ("b", 1)], None, [("x", 1)], None]


def test_stamps_and_ranges(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Seoul")
    try:
        got = spark.sql("select timestamp'2026-07-01 08:30:15.9' as t").select(X.utc_stamp(F.col("t"))).first()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == "2026-06-30T23:30:15+00:00"
    pairs = [("20260101", "20260101"), ("20260101", "20270101"), ("20260101", "20270102"), ("20260201", "20260131"), ("20260230", "20260301"), ("2026011", "20260301"), (None, "20260101")]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").orderBy("i")
    assert [r[0] for r in rows.select(X.range_fault(F.col("a"), F.col("b"), 366)).collect()] == [None, None, "length", "order", "date", "date", "date"]
