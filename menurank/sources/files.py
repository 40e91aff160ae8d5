"""Snapshots, verified corpora, and the scan that falls back to a snapshot when the web source fails."""

from __future__ import annotations

import re
from collections.abc import Callable
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..operators.clean import cleaned, in_range
from ..operators.steps import written
from ..schemas import MANIFEST, RAW, SNAPSHOT
from .web import SourceError, date_range


def from_rows(spark: SparkSession, rows) -> DataFrame:
    """Raw meals from dicts; keys the schema lacks are ignored, other values become text."""
    text = lambda f, v: v if v is None or f.name == "MLSV_FGR" else str(v)
    return spark.createDataFrame([tuple(text(f, r.get(f.name)) for f in RAW.fields) for r in rows], RAW)


def snapshot(spark: SparkSession, path: str, school: str, least: int = 0) -> DataFrame:
    """Rows of a snapshot of this school; SourceError if it can't be read, is of another school or has too few."""
    try:
        whole = spark.read.schema(SNAPSHOT).option("multiLine", True).option("mode", "FAILFAST").json(path)
        told = whole.select("metadata.school_name", F.size("rows").alias("n")).first()
    except Exception as e:
        raise SourceError("the snapshot can't be read") from e
    if told is None or told["school_name"] != school or told["n"] is None or told["n"] < least:
        raise SourceError("the snapshot is of another school or form")
    return whole.select(F.inline("rows"))


def read_once(rows: DataFrame) -> DataFrame:
    """rows, read now and written, so that a page that fails does so here, as a SourceError, and no page is asked for again."""
    try:
        return written(rows)
    except PySparkException as e:
        if told := re.search(r"SourceError: ([^\n]*)", str(e)):
            raise SourceError(told[1]) from None
        raise


def meal_table(spark: SparkSession, school: str, start: str, end: str, fallback: str, fetch: Callable[[str, str, str], DataFrame], on_empty: str = "error") -> tuple[DataFrame, str]:
    """Cleaned meals and where they come from.

    fetch(school, start, end) gives raw rows. Only a SourceError, and only for the school of the snapshot, leads to the
    snapshot; an empty live period is a ValueError, or with on_empty="fallback" treated as a SourceError."""
    date_range(start, end)
    wanted = school.strip()
    if not wanted:
        raise ValueError("a school's name is needed")
    try:
        live = read_once(cleaned(fetch(wanted, start, end)))
        if not live.isEmpty():
            return live, C.LIVE_LABEL
        if on_empty != "fallback":
            raise ValueError("no meals in this period")
        raise SourceError("no meals in this period")
    except SourceError as e:
        if wanted != C.FALLBACK_SCHOOL:
            raise
        stored = snapshot(spark, fallback, wanted)
        rows = in_range(stored, start, end)
        if rows.isEmpty():
            known = stored.filter("MLSV_YMD <> ''").agg(F.min("MLSV_YMD").alias("a"), F.max("MLSV_YMD").alias("b")).first()
            period = f"{known['a']}~{known['b']}" if known["a"] else C.NO_PERIOD
            raise SourceError(f"the source failed and the snapshot has no rows in {start}~{end}; it has {period}") from e
        clean = cleaned(rows)
        if clean.isEmpty():
            raise SourceError("the snapshot has no usable row") from e
        return clean, C.FALLBACK_LABEL.format(reason=e)


def classroom(spark: SparkSession, fallback: str, fetch, school: str = C.FALLBACK_SCHOOL, start: str = "20260624", end: str = "20260630") -> tuple[DataFrame, str]:
    return meal_table(spark, school, start, end, fallback, fetch)


def sample_table(spark: SparkSession, path: str) -> DataFrame:
    """Cleaned rows of the sample snapshot; SourceError without any."""
    out = cleaned(snapshot(spark, path, C.FALLBACK_SCHOOL, 1))
    if out.isEmpty():
        raise SourceError("the sample has no usable row")
    return out


def setup(spark: SparkSession, start: str | Path | None = None, sample: str = "data/sample.json") -> dict:
    """What a session begins with: root (the nearest folder from start upwards that holds the sample), rows, table and source."""
    here = Path(start or Path.cwd()).resolve()
    here = here.parent if here.is_file() else here
    root = next((f for f in (here, *here.parents) if (f / sample).is_file()), None)
    if root is None:
        raise SourceError(f"no folder from {here} upwards holds {sample}")
    path = str(root / sample)
    return {"root": root, "rows": snapshot(spark, path, C.FALLBACK_SCHOOL, 1), "table": sample_table(spark, path), "source": C.SAMPLE_LABEL}


def verified_corpus(spark: SparkSession, manifest: str, folder: str) -> DataFrame:
    """title, file, text of the manifest's files; reading a file whose SHA-256 differs, or that is missing, fails."""
    listed = spark.read.schema(MANIFEST).option("multiLine", True).json(manifest).select(F.inline("documents")).select("title", "file", "sha256")
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    both = listed.join(files, "file", "left")
    ok = F.sha2("content", 256) == F.lower("sha256")
    text = F.when(F.coalesce(ok, F.lit(False)), F.decode("content", "UTF-8")).otherwise(F.raise_error(F.concat(F.lit("not as the manifest says: "), F.col("file"))))
    return both.select("title", "file", text.alias("text"))
