"""A paged JSON web source as a Spark data source. The transport is injected, so tests need no network.

Options: url, dataset, key (never shown), page_size, filters (JSON). One page is read on the driver to learn the total;
each page is then an input partition of its own.
"""

from __future__ import annotations

import json
import os
import sys
from datetime import date, datetime
from typing import NamedTuple
from urllib.parse import urlencode

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..schemas import RAW, SCHOOL, SCHOOL_ROW, envelope

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package

TIMEOUT_S, PAGE_ROWS, MOST_DAYS = 15, 1000, 366
OK, NONE = "INFO-000", "INFO-200"  # Fixed values: codes of the source's answers.
SCHOOLS, MEALS = "schoolInfo", "mealServiceDietInfo"  # Fixed values: names of its datasets.


class SourceError(RuntimeError):
    """Any failure of the source."""


def date_range(start: str, end: str) -> tuple[date, date]:
    """yyyyMMdd texts as dates; ValueError if they are none, out of order or span more than MOST_DAYS."""
    try:
        first, last = (datetime.strptime(x, "%Y%m%d").date() for x in (start, end))
    except ValueError as e:
        raise ValueError("dates must be real ones, as yyyyMMdd") from e
    if first > last:
        raise ValueError("start must not be after end")
    if (last - first).days >= MOST_DAYS:
        raise ValueError(f"at most {MOST_DAYS} days")
    return first, last


def shown(url: str, params: dict) -> str:
    """The request without its key."""
    return f"{url}?{urlencode({k: v for k, v in params.items() if k.upper() != 'KEY'})}"


def shown_url(url, params):
    """`shown` of columns: an address and a map of parameters, in the map's order."""
    kept = F.map_entries(F.map_filter(params, lambda k, _: F.upper(k) != "KEY"))
    return F.concat(url, F.lit("?"), F.array_join(F.transform(kept, lambda e: F.concat(F.url_encode(e["key"]), F.lit("="), F.url_encode(e["value"]))), "&"))


class Answer(NamedTuple):
    """What a request gave: the object, the address without the key, and the status (None if the transport tells none)."""

    json: dict
    url: str
    status: int | None


def request(url: str, params: dict, http_get=None, key: str | None = None) -> Answer:
    """One request; any failure or an answer that is no object is a SourceError that doesn't carry the key."""
    secret, status = (key or "").strip(), None
    if http_get is None:
        from urllib.request import urlopen

        def http_get(u, params, timeout):
            nonlocal status
            with urlopen(f"{u}?{urlencode(params)}", timeout=timeout) as got:
                status = got.status
                return json.load(got)

    try:
        answer = http_get(url, params={**params, **({"KEY": secret} if secret else {})}, timeout=TIMEOUT_S)
        if hasattr(answer, "raise_for_status"):
            answer.raise_for_status()
            status = getattr(answer, "status_code", None)
            answer = answer.json()
    except Exception:
        raise SourceError(f"no answer from {shown(url, params)}") from None
    if not isinstance(answer, dict):
        raise SourceError("the answer is no object")
    return Answer(answer, shown(url, params), status)


def get_json(url: str, params: dict, http_get=None, key: str | None = None) -> dict:
    return request(url, params, http_get, key).json


FORM = "the answer has another form"


def opened(answer: dict, dataset: str) -> tuple[dict, list | None]:
    """What an answer's head says (of entries with one name the first) and its rows, None without any."""
    match answer:
        case {"RESULT": {**root}}:
            return {"RESULT": root}, None
    match answer.get(dataset):
        case [head, body, *_]:
            entries = head.get("head", []) if isinstance(head, dict) else []
            said: dict = {}
            for entry in filter(lambda e: isinstance(e, dict), entries):
                said = {**entry, **said}
            return said, body.get("row") if isinstance(body, dict) else None
        case [{"head": [*entries]}]:
            return {"alone": True, **{k: v for e in reversed(entries) if isinstance(e, dict) for k, v in e.items()}}, None
    raise SourceError(FORM)


def rows_of(answer: dict, dataset: str) -> list[dict]:
    """Rows of an answer; none for the code that says so; SourceError for other codes and forms."""
    said, rows = opened(answer, dataset)
    match said.get("RESULT"):
        case {"CODE": code, **more} if code not in (None, OK):
            if code == NONE:
                return []
            raise SourceError(f"the source says: {more.get('MESSAGE', 'an unknown error')}")
        case dict() if "RESULT" in answer:
            raise SourceError(FORM)
    if said.get("alone") or not (rows is None or isinstance(rows, list) and {type(r) for r in rows} <= {dict}):
        raise SourceError(FORM)
    return rows or []


def total_of(answer: dict, dataset: str) -> int | None:
    """How many rows the source has in all, None if it doesn't say."""
    try:
        said, _ = opened(answer, dataset)
    except SourceError:
        return None
    if "list_total_count" not in said:
        return None
    text = str(said["list_total_count"]).strip()
    if not text.lstrip("-").isdigit():
        raise SourceError("the total is no number")
    return max(0, int(text))


class Page(InputPartition):
    def __init__(self, number: int, rows: list[dict] | None = None):
        self.number, self.rows = number, rows


class PagedReader(DataSourceReader):
    def __init__(self, schema, options, http_get):
        self.columns = [f.name for f in schema.fields]
        self.options, self.http_get = dict(options), http_get

    def page(self, number: int) -> dict:
        o = self.options
        params = {"Type": "json", "pIndex": number, "pSize": int(o.get("page_size", PAGE_ROWS)), **json.loads(o.get("filters", "{}"))}
        return get_json(o["url"], params, self.http_get, o.get("key") or os.environ.get("MEALS_API_KEY"))

    def partitions(self):
        first = self.page(1)
        got, total = rows_of(first, self.options["dataset"]), total_of(first, self.options["dataset"])
        pages = -(-total // max(1, len(got))) if got and total is not None else 1
        return [Page(1, got), *(Page(n + 1) for n in range(1, pages))]  # the first was read to learn the total

    def read(self, partition):
        rows = partition.rows if partition.rows is not None else rows_of(self.page(partition.number), self.options["dataset"])
        for row in rows:
            yield tuple(row.get(c) for c in self.columns)


class Rows(InputPartition):
    """Rows first to last (exclusive) of the source's order, all on one page."""

    def __init__(self, number: int, first: int, last: int):
        self.number, self.first, self.last = number, first, last


class PagedStreamReader(PagedReader, DataSourceStreamReader):
    """The source as a stream: an offset is how many rows have been read. Without option partial="true" a page is read once
    it is full, so that no page is ever asked for twice; with it a page that has grown is read again for its new rows."""

    def initialOffset(self) -> dict:
        return {"rows": 0}

    def latestOffset(self) -> dict:
        size = int(self.options.get("page_size", PAGE_ROWS))
        probe = {"Type": "json", "pIndex": 1, "pSize": 1, **json.loads(self.options.get("filters", "{}"))}
        answer = get_json(self.options["url"], probe, self.http_get, self.options.get("key") or os.environ.get("MEALS_API_KEY"))
        rows_of(answer, self.options["dataset"])  # an answer that is an error raises
        total = total_of(answer, self.options["dataset"]) or 0
        return {"rows": total if self.options.get("partial") == "true" else total // size * size}

    def partitions(self, start: dict, end: dict) -> list[Rows]:
        size, out, at = int(self.options.get("page_size", PAGE_ROWS)), [], start["rows"]
        while at < end["rows"]:
            upto = min(end["rows"], (at // size + 1) * size)
            out.append(Rows(at // size + 1, at % size, upto - at // size * size))
            at = upto
        return out

    def read(self, partition: Rows):
        got = rows_of(self.page(partition.number), self.options["dataset"])[partition.first : partition.last]
        if len(got) < partition.last - partition.first:
            raise SourceError("a page has fewer rows than the source said")
        for row in got:
            yield tuple(row.get(c) for c in self.columns)

    def commit(self, end: dict) -> None:
        """Nothing to do: the stream's checkpoint keeps the offset."""


def paged_source(name: str, schema, http_get=None) -> type[DataSource]:
    """A data source class to register; http_get (picklable) does the requests."""

    class Paged(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return schema

        def reader(self, schema):
            return PagedReader(schema, self.options, http_get)

        def streamReader(self, schema):
            return PagedStreamReader(schema, self.options, http_get)

    return Paged


def find_school(spark: SparkSession, url: str, name: str, http_get=None, key: str | None = None) -> DataFrame:
    """The first school of exactly this name, as one row of SCHOOL; ValueError for a blank name, SourceError for none."""
    wanted = name.strip()
    if not wanted:
        raise ValueError("a school's name is needed")
    answer = get_json(f"{url}/{SCHOOLS}", {"Type": "json", "pIndex": 1, "pSize": 100, "SCHUL_NM": wanted}, http_get, key)
    rows = [tuple(str(r.get(c) or "") for c in SCHOOL_ROW.fieldNames()) for r in rows_of(answer, SCHOOLS)]
    found = spark.createDataFrame(rows, SCHOOL_ROW).filter(F.trim("SCHUL_NM") == wanted).limit(1)
    columns = ["SCHUL_NM", "ATPT_OFCDC_SC_CODE", "SD_SCHUL_CODE", "SCHUL_KND_SC_NM", "ORG_RDNMA"]
    school = found.select(*(F.coalesce(F.col(a), F.lit("")).alias(b) for a, b in zip(columns, SCHOOL.fieldNames(), strict=True)))
    if school.isEmpty():
        raise SourceError(f"no school is named exactly '{wanted}'")
    return school


def meals(spark: SparkSession, url: str, school: DataFrame, start: str, end: str, http_get=None, page_rows: int = PAGE_ROWS, key: str | None = None) -> DataFrame:
    """Raw meals of a school and period; school and period go to the source as filters, pages are read in parallel."""
    date_range(start, end)
    one = school.first()
    spark.dataSource.register(paged_source("paged_meals", RAW, http_get))
    filters = {"ATPT_OFCDC_SC_CODE": one["office_code"], "SD_SCHUL_CODE": one["school_code"], "MLSV_FROM_YMD": start, "MLSV_TO_YMD": end}
    options = {"url": f"{url}/{MEALS}", "dataset": MEALS, "filters": json.dumps(filters), "page_size": str(page_rows), **({"key": key} if key else {})}
    return spark.read.format("paged_meals").options(**options).load()


def meals_of_schools(spark: SparkSession, url: str, names: DataFrame, start: str, end: str, http_get=None, page_rows: int = PAGE_ROWS, key: str | None = None) -> DataFrame:
    """Raw meals of all schools named in the column `name`, each with that name: two lateral calls of the source, one that
    looks a school up and one that reads its pages. Tasks do so for their own names; the driver sees none of them.

    Names are stripped; blank and null ones are left out, repeated ones asked for once. A name that no school has exactly, or
    an answer that is an error, fails the job. A school's period is at most MOST_DAYS days, so its pages are few."""
    from pyspark.sql.functions import udtf

    date_range(start, end)
    columns = [f.name for f in RAW.fields]

    class Lookup:
        def eval(self, name: str):
            answer = get_json(f"{url}/{SCHOOLS}", {"Type": "json", "pIndex": 1, "pSize": 100, "SCHUL_NM": name}, http_get, key)
            for row in rows_of(answer, SCHOOLS):
                if str(row.get("SCHUL_NM") or "").strip() == name:
                    yield str(row.get("ATPT_OFCDC_SC_CODE") or ""), str(row.get("SD_SCHUL_CODE") or "")
                    return
            raise SourceError(f"no school is named exactly '{name}'")

    class Pages:
        def eval(self, office: str, school: str):
            filters = {"ATPT_OFCDC_SC_CODE": office, "SD_SCHUL_CODE": school, "MLSV_FROM_YMD": start, "MLSV_TO_YMD": end}
            number, seen = 1, 0
            while True:
                answer = get_json(f"{url}/{MEALS}", {"Type": "json", "pIndex": number, "pSize": page_rows, **filters}, http_get, key)
                rows, total = rows_of(answer, MEALS), total_of(answer, MEALS)
                for row in rows:
                    yield tuple(row.get(c) for c in columns)
                number, seen = number + 1, seen + len(rows)
                if not rows or total is None or seen >= total:
                    return

    look_up = udtf(Lookup, returnType="office_code string, school_code string")
    read = udtf(Pages, returnType=RAW)
    wanted = names.select(F.trim("name").alias("name")).filter("name <> ''").distinct()
    schools = wanted.lateralJoin(look_up(F.col("name").outer()))
    return schools.lateralJoin(read(F.col("office_code").outer(), F.col("school_code").outer())).select("name", *columns)


def rows_in(column, dataset: str, row):
    """The rows in a stored JSON answer, null without any; an error code or another form raises when read."""
    a = F.from_json(column, envelope(dataset, row))
    heads = F.filter(F.get(a[dataset], F.lit(0))["head"], lambda h: h["RESULT"].isNotNull())
    code = F.coalesce(a["RESULT"]["CODE"], F.get(heads, F.lit(0))["RESULT"]["CODE"], F.lit(OK))
    bad = (~code.isin(OK, NONE)) | (a["RESULT"].isNotNull() & (code == OK)) | (a["RESULT"].isNull() & (F.coalesce(F.size(a[dataset]), F.lit(0)) < 2))
    return F.when(bad, F.raise_error(F.concat(F.lit("answer: "), code))).when(code == OK, F.get(a[dataset], F.lit(1))["row"])


def unnested(answers: DataFrame, column: str, dataset: str, row) -> DataFrame:
    """Rows in stored JSON answers (see `rows_in`). Answers without rows give none."""
    return answers.select(F.inline(rows_in(F.col(column), dataset, row)))


def total_count(column, dataset: str, row):
    """list_total_count of a stored answer, at least 0; null without one."""
    head = F.get(F.from_json(column, envelope(dataset, row))[dataset], F.lit(0))["head"]
    told = F.get(F.filter(head, lambda h: h["list_total_count"].isNotNull()), F.lit(0))["list_total_count"]
    return F.when(told < 0, 0).otherwise(told)
