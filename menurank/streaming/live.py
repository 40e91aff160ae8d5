"""Streams: cleaning is stateless; ranking needs whole-corpus statistics and runs on each micro-batch's table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.clean import cleaned
from ..operators.recommend import Profile, Rules, recommend
from ..schemas import RAW


def cleaned_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Cleaned meals of JSON files that arrive in folder."""
    return cleaned(spark.readStream.schema(RAW).json(folder))


def ranked_stream(stream: DataFrame, key: str, profile: Profile, sink, checkpoint: str, top: int = 3, rules: Rules | None = None):
    """Starts a query that gives sink(ranked, batch number) the best rows of each micro-batch."""

    def each(rows: DataFrame, number: int) -> None:
        if not rows.isEmpty():
            sink(recommend(rows, key, profile, top, rules), number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
