import hashlib
import json
import sys

import pytest
from pyspark import cloudpickle

from menurank import constants as C
from menurank.operators import report
from menurank.operators.recommend import Profile
from menurank.schemas import RAW
from menurank.sources import files, web
from menurank.streaming import live

cloudpickle.register_pickle_by_value(sys.modules[__name__])
URL = "http://meals.invalid/hub"


def meal(day, **more):
    return {"MLSV_YMD": day, "DDISH_NM": "쌀밥 (5)<br/>국 (1.2)", "SCHUL_NM": C.FALLBACK_SCHOOL, "MMEAL_SC_NM": C.LUNCH, "CAL_INFO": "700 Kcal", "NTR_INFO": "", **more}


def answer(dataset, rows, total=None, code="INFO-000"):
    return {dataset: [{"head": [{"list_total_count": len(rows) if total is None else total}, {"RESULT": {"CODE": code, "MESSAGE": "m"}}]}, {"row": rows}]}


def pages(url, params, timeout):
    every = [meal(f"2026070{i}") for i in range(1, 6)]
    if url.endswith(web.SCHOOLS):
        return answer(web.SCHOOLS, [{"SCHUL_NM": "다른 학교"}, {"SCHUL_NM": f" {C.FALLBACK_SCHOOL} ", "ATPT_OFCDC_SC_CODE": "Q10", "SD_SCHUL_CODE": "7"}])
    first = (params["pIndex"] - 1) * params["pSize"]
    return answer(web.MEALS, every[first : first + params["pSize"]], 5)


def test_pages_become_partitions(spark):
    school = web.find_school(spark, URL, C.FALLBACK_SCHOOL, pages)
    got = web.meals(spark, URL, school, "20260701", "20260731", pages, 2)
    assert got.schema == RAW and sorted(r["MLSV_YMD"] for r in got.collect()) == [f"2026070{i}" for i in range(1, 6)]
    assert got.rdd.getNumPartitions() == 3


def test_school_must_match_exactly(spark):
    with pytest.raises(web.SourceError):
        web.find_school(spark, URL, "다른", pages)
    with pytest.raises(ValueError):
        web.find_school(spark, URL, "  ", pages)


def test_answers(spark):
    assert web.rows_of(answer("d", [], code="INFO-200"), "d") == [] and web.rows_of({"RESULT": {"CODE": "INFO-200"}}, "d") == []
    assert web.rows_of({"d": [{"head": []}, {}]}, "d") == [] and web.total_of({"d": [{"head": []}, {}]}, "d") is None
    assert web.total_of(answer("d", [], -4), "d") == 0
    for bad in ({"RESULT": {"CODE": "ERROR-300", "MESSAGE": "no"}}, {"x": []}, {"d": [{}]}, {"d": [{}, {"row": [1]}]}, answer("d", [], code="ERROR-1")):
        with pytest.raises(web.SourceError):
            web.rows_of(bad, "d")
    stored = spark.createDataFrame([(json.dumps(answer("d", [meal("20260701")], 9)),), (json.dumps({"RESULT": {"CODE": "INFO-200"}}),)], "a string")
    assert web.unnested(stored, "a", "d", RAW).count() == 1
    assert {r[0] for r in stored.select(web.total_count(stored["a"], "d", RAW)).collect()} == {9, None}


def test_the_key_is_never_shown():
    def fails(url, params, timeout):
        assert params["KEY"] == "s3cret"
        raise OSError(f"bad {params}")

    with pytest.raises(web.SourceError) as e:
        web.get_json(URL, {"pIndex": 1}, fails, " s3cret ")
    assert "s3cret" not in str(e.value) and e.value.__cause__ is None
    assert "KEY" not in web.shown(URL, {"KEY": "s3cret", "a": 1})


def test_date_ranges():
    web.date_range("20260101", "20270101")
    for bad in (("20260101", "20270102"), ("20260102", "20260101"), ("20260230", "20260301")):
        with pytest.raises(ValueError):
            web.date_range(*bad)


@pytest.fixture
def sample(tmp_path):
    path = tmp_path / "sample.json"
    path.write_text(json.dumps({"metadata": {"school_name": C.FALLBACK_SCHOOL}, "rows": [meal("20260624"), meal("20260625")]}, ensure_ascii=False))
    return str(path)


def fails(*_):
    raise web.SourceError("down")


def test_fallback(spark, sample):
    rows, label = files.meal_table(spark, C.FALLBACK_SCHOOL, "20260601", "20260630", sample, fails)
    assert rows.count() == 2 and "down" in label
    with pytest.raises(web.SourceError, match="20260624~20260625"):
        files.meal_table(spark, C.FALLBACK_SCHOOL, "20260701", "20260730", sample, fails)
    with pytest.raises(web.SourceError):
        files.meal_table(spark, "다른 학교", "20260601", "20260630", sample, fails)
    with pytest.raises(web.SourceError):
        files.snapshot(spark, sample, "다른 학교")


def test_an_empty_live_period_is_an_error(spark, sample):
    empty = lambda *_: files.from_rows(spark, [])
    with pytest.raises(ValueError):
        files.meal_table(spark, C.FALLBACK_SCHOOL, "20260601", "20260630", sample, empty)
    assert files.meal_table(spark, C.FALLBACK_SCHOOL, "20260601", "20260630", sample, empty, "fallback")[0].count() == 2
    rows, label = files.classroom(spark, sample, lambda *_: files.from_rows(spark, [meal("20260624")]))
    assert rows.count() == 1 and label == C.LIVE_LABEL
    assert files.sample_table(spark, sample).count() == 2


def test_snapshot_round_trip(spark, tmp_path):
    raw = files.from_rows(spark, [meal(f"2026060{i}") for i in range(1, 7)] + [meal("20260601", MMEAL_SC_NM="석식")])
    assert report.write_snapshot(raw, str(tmp_path / "s"), {"school_name": C.FALLBACK_SCHOOL}) == 6
    assert files.snapshot(spark, str(tmp_path / "s"), C.FALLBACK_SCHOOL).count() == 6
    with pytest.raises(ValueError):
        report.write_snapshot(raw.limit(2), str(tmp_path / "t"), {})


def test_corpus_is_verified(spark, tmp_path):
    folder = tmp_path / "docs"
    folder.mkdir()
    (folder / "a.md").write_text("가나다")
    listed = {"documents": [{"title": "A", "file": "a.md", "sha256": hashlib.sha256("가나다".encode()).hexdigest()}]}
    (tmp_path / "m.json").write_text(json.dumps(listed))
    assert files.verified_corpus(spark, str(tmp_path / "m.json"), str(folder)).first()["text"] == "가나다"
    (folder / "a.md").write_text("changed")
    with pytest.raises(Exception, match="not as the manifest says"):
        files.verified_corpus(spark, str(tmp_path / "m.json"), str(folder)).collect()


def test_stream_of_meals_is_ranked(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps(meal(f"2026060{i}"), ensure_ascii=False) for i in range(1, 5)))
    got = []
    stream = live.cleaned_stream(spark, str(tmp_path / "in"))
    q = live.ranked_stream(stream, "date", Profile(("쌀밥",)), lambda ranked, n: got.extend(ranked.collect()), str(tmp_path / "cp"), 2)
    q.awaitTermination(120)
    assert len(got) == 2 and got[0]["score"] >= got[1]["score"]


def test_a_page_that_fails_leads_to_the_snapshot(spark, tmp_path):
    """The first page answers, a later one doesn't; the snapshot's rows come instead, and the label says why."""
    asked = str(tmp_path / "asked")

    def breaks(url, params, timeout):
        if url.endswith(web.SCHOOLS):
            return pages(url, params, timeout)
        with open(asked, "a") as f:
            f.write(f"{params['pIndex']} ")
        if params["pIndex"] > 1:
            raise OSError("gone")
        return pages(url, params, timeout)

    path = tmp_path / "kept.json"
    path.write_text(json.dumps({"metadata": {"school_name": C.FALLBACK_SCHOOL}, "rows": [meal("20260701"), meal("20260702")]}, ensure_ascii=False))

    def fetch(get):
        return lambda name, start, end: web.meals(spark, URL, web.find_school(spark, URL, name, get), start, end, get, 2)

    rows, label = files.meal_table(spark, C.FALLBACK_SCHOOL, "20260701", "20260731", str(path), fetch(breaks))
    assert rows.count() == 2 and label == C.FALLBACK_LABEL.format(reason=label.rpartition(": ")[2]) and "no answer" in label
    assert open(asked).read().split().count("1") == 1
    rows, label = files.meal_table(spark, C.FALLBACK_SCHOOL, "20260701", "20260731", str(path), fetch(pages))
    assert rows.count() == 5 and label == C.LIVE_LABEL


def test_a_root_result_without_rows_is_no_answer(spark):
    odd = {"RESULT": {"CODE": web.OK, "MESSAGE": "m"}}
    with pytest.raises(web.SourceError):
        web.rows_of(odd, "d")
    with pytest.raises(Exception, match="INFO-000"):
        web.unnested(spark.createDataFrame([(json.dumps(odd),)], "a string"), "a", "d", RAW).collect()


def test_answers_carry_status_and_safe_address():
    class Response:
        status_code = 203

        def raise_for_status(self):
            pass

        def json(self):
            return {"a": 1}

    got = web.request(URL, {"b": 2}, lambda url, params, timeout: Response(), "s3cret")
    assert got == ({"a": 1}, f"{URL}?b=2", 203) and web.request(URL, {}, lambda *a, **k: {"x": 1}).status is None


def two_schools(url, params, timeout):
    if url.endswith(web.SCHOOLS):
        return answer(web.SCHOOLS, [{"SCHUL_NM": n, "ATPT_OFCDC_SC_CODE": "O", "SD_SCHUL_CODE": n[-1]} for n in ("school 1", "school 2", "school 22") if n.startswith(params["SCHUL_NM"])])
    every = [meal(f"202607{i:02}", SCHUL_NM=f"school {params['SD_SCHUL_CODE']}") for i in range(1, 6 + int(params["SD_SCHUL_CODE"]))]
    first = (params["pIndex"] - 1) * params["pSize"]
    return answer(web.MEALS, every[first : first + params["pSize"]], len(every))


def test_meals_of_many_schools_without_a_driver_loop(spark):
    names = spark.createDataFrame([(" school 1",), ("school 2",), ("school 1",), (" ",), (None,)], "name string")
    got = web.meals_of_schools(spark, URL, names, "20260701", "20260731", two_schools, 2)
    rows = got.collect()
    assert got.columns[0] == "name" and sorted((r["name"], r["MLSV_YMD"]) for r in rows) == [(f"school {k}", f"202607{i:02}") for k in (1, 2) for i in range(1, 6 + k)]
    assert all(r["SCHUL_NM"] == r["name"] for r in rows)
    with pytest.raises(Exception, match="no school is named exactly"):
        web.meals_of_schools(spark, URL, spark.createDataFrame([("school",)], "name string"), "20260701", "20260731", two_schools).collect()


def test_stream_of_pages_reads_no_page_twice(spark, tmp_path):
    log, size = str(tmp_path / "asked"), str(tmp_path / "size")

    def growing(url, params, timeout):
        if params["pSize"] > 1:
            with open(log, "a") as f:
                f.write(f"{params['pIndex']} ")
        with open(size) as f:
            every = [meal(f"202607{i:02}") for i in range(1, 1 + int(f.read()))]
        first = (params["pIndex"] - 1) * params["pSize"]
        return answer(web.MEALS, every[first : first + params["pSize"]], len(every))

    def run():
        options = {"url": URL, "dataset": web.MEALS, "page_size": "2"}
        query = spark.readStream.format("streamed_meals").options(**options).load().select("MLSV_YMD").writeStream.format("parquet")
        q = query.option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
        try:
            import time

            for _ in range(60):
                q.processAllAvailable() if q.isActive else None
                time.sleep(0.5)
                if q.lastProgress:
                    break
        finally:
            q.stop()
        return sorted(r[0] for r in spark.read.schema("MLSV_YMD string").parquet(str(tmp_path / "out")).collect())

    spark.dataSource.register(web.paged_source("streamed_meals", RAW, growing))
    open(size, "w").write("5")
    assert run() == [f"202607{i:02}" for i in range(1, 5)]  # the fifth row's page isn't full
    open(size, "w").write("8")
    assert run() == [f"202607{i:02}" for i in range(1, 9)]
    asked = open(log).read().split()
    assert sorted(asked) == ["1", "2", "3", "4"]


def test_partitions_of_a_stream():
    reader = web.PagedStreamReader(RAW, {"page_size": "10"}, None)
    made = [(p.number, p.first, p.last) for p in reader.partitions({"rows": 7}, {"rows": 25})]
    assert made == [(1, 7, 10), (2, 0, 10), (3, 0, 5)] and reader.partitions({"rows": 5}, {"rows": 5}) == [] and reader.initialOffset() == {"rows": 0}


def test_report_sink_commits_whole_and_aborts_clean(spark, tmp_path):
    from pyspark.sql import functions as F

    from menurank.sources import reports

    path = str(tmp_path / "report")
    runs = spark.range(100).repartition(5).select(F.col("id").cast("string").alias("chapter"), F.when(F.col("id") % 4 == 0, "FAIL").otherwise("PASS").alias("status"), (F.col("id") / 8).alias("seconds"))
    reports.write_report(runs, path)
    assert reports.report_totals(spark, path).drop("parts").first() == (75, 25, round(sum(i / 8 for i in range(100)), 2))
    assert reports.report_rows(spark, path, "chapter string, status string, seconds double").count() == 100
    before = sorted(p.name for p in (tmp_path / "report").iterdir())
    breaks = runs.withColumn("seconds", F.when(F.col("chapter") == "77", F.raise_error(F.lit("broken"))).otherwise(F.col("seconds")))
    with pytest.raises(Exception, match="broken"):
        reports.write_report(breaks, path)
    assert sorted(p.name for p in (tmp_path / "report").iterdir()) == before  # the old report stands, nothing is left over
    (tmp_path / "report" / "part-stray.json").write_text('{"chapter": "stray", "status": "PASS", "seconds": 1}')
    assert reports.report_rows(spark, path, "chapter string").filter("chapter = 'stray'").count() == 0
    reports.write_report(runs.limit(0), path)
    assert reports.report_totals(spark, path).first()["passed"] == 0 and reports.report_rows(spark, path, "chapter string").count() == 0
    with pytest.raises(Exception, match="missing columns: seconds"):
        reports.write_report(runs.drop("seconds"), path)


def test_setup_and_card(spark, tmp_path):
    from pyspark.sql import functions as F

    (tmp_path / "data").mkdir()
    (tmp_path / "data" / "sample.json").write_text(json.dumps({"metadata": {"school_name": C.FALLBACK_SCHOOL}, "rows": [meal("20260701"), meal("20260702")]}, ensure_ascii=False))
    (tmp_path / "a" / "b").mkdir(parents=True)
    got = files.setup(spark, tmp_path / "a" / "b")
    assert got["root"] == tmp_path and got["rows"].count() == got["table"].count() == 2 and got["source"] == C.SAMPLE_LABEL
    with pytest.raises(web.SourceError):
        files.setup(spark, tmp_path / "a" / "b", "data/other.json")
    card = report.model_card(spark.range(1), {"a": F.lit("x"), "b": F.lit(None), "c": F.col("id")})
    assert report.card_faults(card, ["a", "c"]).collect() == [("b", "empty")]
    assert sorted(report.card_faults(card.union(card.limit(1)), ["a", "d"]).collect()) == [("a", "twice"), ("b", "empty"), ("d", "missing")]
    assert "20260702" in report.console(got["rows"].select("MLSV_YMD"), [F.desc("MLSV_YMD")], 1) and report.head(got["rows"], ["MLSV_YMD"], 1).first()["MLSV_YMD"] == "20260701"
