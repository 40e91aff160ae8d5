"""Raw meal rows to the cleaned table: one projection, no UDF, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import CLEAN_COLUMNS
from ..functions import text as X


def cleaned(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The eleven columns (after those in keep) of the rows that have a date and a dish. Missing texts are empty,
    missing numbers null. Missing raw columns count as null."""
    get = lambda c: F.col(c) if c in raw.columns else F.lit(None).cast("string")
    text = lambda c: X.stripped(F.coalesce(get(c), F.lit("")))
    # Date and dishes are made once, inside a generator: a filter on them would be pushed below, and make them twice.
    both = F.array(F.struct(X.compact_date(get("MLSV_YMD")).alias("_date"), X.dishes(get("DDISH_NM")).alias("_dishes")))
    whole = raw.select("*", F.inline(F.filter(both, lambda r: r["_date"].isNotNull() & (F.size(r["_dishes"]) > 0))))
    first = whole.select(
        *keep,
        F.col("_date").alias("date"),
        text("SCHUL_NM").alias("school_name"),
        text("MMEAL_SC_NM").alias("meal_type"),
        F.col("_dishes").alias("dishes"),
        X.codes(get("DDISH_NM")).alias("allergy_codes"),
        X.first_number(get("CAL_INFO")).alias("calories"),
        *(X.nutrient(get("NTR_INFO"), n).alias(n) for n in ("carbs_g", "protein_g", "fat_g")),
    )
    return first.withColumn("menu_text", F.array_join("dishes", " ")).withColumn("dish_count", F.size("dishes")).select(*keep, *CLEAN_COLUMNS)


def in_range(raw: DataFrame, start: str, end: str) -> DataFrame:
    """Raw rows whose date text lies between start and end (as texts, inclusive); a null date counts as the empty text. The
    comparison is of the column itself, so that the scan can skip what lies outside."""
    inside = F.col("MLSV_YMD").between(start, end)
    return raw.filter(inside | F.col("MLSV_YMD").isNull() if start == "" else inside)


def without_codes(rows: DataFrame, codes: list[int]) -> DataFrame:
    """Rows with none of these allergy codes; null codes count as none."""
    own = F.coalesce("allergy_codes", F.expr("cast(array() as array<int>)"))
    return rows.filter(~F.arrays_overlap(own, F.lit(codes).cast("array<int>"))) if codes else rows
