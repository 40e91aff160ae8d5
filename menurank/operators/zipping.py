"""Rows of two tables joined by their position in an order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .steps import written

_BITS = 33  # monotonically_increasing_id holds the partition above so many bits and the row's place in it below


def numbered(rows: DataFrame, order: list[str], name: str = "position") -> tuple[DataFrame, int]:
    """rows with their 0-based position in the order, and how many there are. order must be total.

    Rows are dealt into ranges of the order and sorted there; a range's place in the whole is the sum of the sizes of those
    before it, one number a partition. No window over all rows, and no partition holds more than its range."""
    at = "_at"
    dealt = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()))
    part = F.shiftright(F.col(at), _BITS)
    sizes = sorted(dealt.groupBy(part.alias("part")).count().collect())  # a row a partition
    firsts, total = {}, 0
    for r in sizes:
        firsts[r["part"]], total = total, total + r["count"]
    offsets = rows.sparkSession.createDataFrame(list(firsts.items()), "_part long, _first long")
    place = F.col("_first") + F.col(at).bitwiseAND(F.lit((1 << _BITS) - 1))
    out = dealt.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return out.withColumn(name, place).drop("_part", "_first", at), total


def zipped(left: DataFrame, left_order: list[str], right: DataFrame, right_order: list[str], strict: bool = False, name: str = "position") -> DataFrame:
    """Each left row with the right row at the same position. Without strict the longer table's rest is left out; with it
    different lengths are a ValueError. A column of both tables is an error, as is a column named as `name`."""
    if clash := sorted({*left.columns, name} & set(right.columns) | {name} & set(left.columns)):
        raise ValueError(f"columns of both tables: {', '.join(clash)}")
    (a, n), (b, m) = numbered(left, left_order, name), numbered(right, right_order, name)
    if strict and n != m:
        raise ValueError(f"{n} rows beside {m}")
    return a.join(b, name)
