"""Run reports as a sink: rows of one result each, and totals that are written when all tasks have succeeded.

Each task writes its rows to a part of its own; the job's commit writes report.json, which names the parts and has the totals.
Readers take parts that it names only, so a task that failed or ran twice leaves nothing that is read; an abort deletes.
"""

from __future__ import annotations

import json
import sys
import uuid
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package

FORMAT, REPORT = "run_report", "report.json"


def opened(path: str):
    """The file system of a path, and the path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Part(WriterCommitMessage):
    name: str
    rows: int
    passed: int
    seconds: float


class ReportWriter(DataSourceArrowWriter):
    def __init__(self, path: str, run: str):
        self.path, self.run = path.rstrip("/"), run

    def write(self, iterator) -> Part:
        """One task's rows, as JSON lines."""
        system, folder = opened(self.path)
        system.create_dir(folder, recursive=True)
        part = Part(f"part-{self.run}-{uuid.uuid4().hex}.json", 0, 0, 0.0)
        with system.open_output_stream(f"{folder}/{part.name}") as out:
            for batch in iterator:
                for row in batch.to_pylist():
                    out.write((json.dumps(row, ensure_ascii=False, default=str) + "\n").encode())
                    part.rows += 1
                    part.passed += row["status"] == "PASS"
                    part.seconds += row["seconds"] or 0.0
        return part

    def commit(self, messages) -> None:
        parts = [m for m in messages if m is not None]
        done, rows = sum(p.passed for p in parts), sum(p.rows for p in parts)
        told = {"passed": done, "failed": rows - done, "total_seconds": round(sum(p.seconds for p in parts), 2), "parts": sorted(p.name for p in parts if p.rows)}
        system, folder = opened(self.path)
        new = f"{folder}/.{REPORT}-{self.run}"
        with system.open_output_stream(new) as out:
            out.write(json.dumps(told, ensure_ascii=False, indent=2).encode())
        system.move(new, f"{folder}/{REPORT}")

    def abort(self, messages) -> None:
        """Parts of tasks that succeeded go, and those that others left."""
        from pyarrow import fs

        system, folder = opened(self.path)
        for info in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if info.base_name.startswith(f"part-{self.run}-"):
                system.delete_file(info.path)


class ReportSink(DataSource):
    """df.write.format("run_report").mode("overwrite").save(path); columns status and seconds are needed, others are kept."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> ReportWriter:
        if missing := sorted({"status", "seconds"} - set(schema.fieldNames())):
            raise ValueError(f"missing columns: {', '.join(missing)}")
        return ReportWriter(self.options["path"], uuid.uuid4().hex)


def write_report(runs: DataFrame, path: str) -> None:
    """runs (status, seconds and whatever tells them apart) to a report. A report written there before is replaced when the
    new one is whole."""
    runs.sparkSession.dataSource.register(ReportSink)
    runs.write.format(FORMAT).mode("overwrite").save(path)


def report_totals(spark: SparkSession, path: str) -> DataFrame:
    """passed, failed, total_seconds and parts of a report."""
    return spark.read.schema("passed long, failed long, total_seconds double, parts array<string>").option("multiLine", True).json(f"{path.rstrip('/')}/{REPORT}")


def report_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a report that was committed."""
    parts = [f"{path.rstrip('/')}/{p}" for p in report_totals(spark, path).first()["parts"]]
    return spark.read.schema(schema).json(parts) if parts else spark.createDataFrame([], schema)
