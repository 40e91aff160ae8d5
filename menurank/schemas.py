"""Declared schemas; nothing is inferred."""

from pyspark.sql import types as T

from .constants import CLEAN_COLUMNS

_TEXTS = ["ATPT_OFCDC_SC_CODE", "ATPT_OFCDC_SC_NM", "SD_SCHUL_CODE", "SCHUL_NM", "MMEAL_SC_CODE", "MMEAL_SC_NM", "MLSV_YMD"]
_MORE = ["DDISH_NM", "ORPLC_INFO", "CAL_INFO", "NTR_INFO", "MLSV_FROM_YMD", "MLSV_TO_YMD", "LOAD_DTM"]

#: A raw meal: everything is text but the head count.
RAW = T.StructType([*(T.StructField(c, T.StringType()) for c in _TEXTS), T.StructField("MLSV_FGR", T.DoubleType()), *(T.StructField(c, T.StringType()) for c in _MORE)])
SCHOOL_ROW = T.StructType([T.StructField(c, T.StringType()) for c in ("ATPT_OFCDC_SC_CODE", "SD_SCHUL_CODE", "SCHUL_NM", "SCHUL_KND_SC_NM", "ORG_RDNMA")])
SCHOOL = T.StructType([T.StructField(c, T.StringType()) for c in ("name", "office_code", "school_code", "school_kind", "address")])
RESULT = T.StructType([T.StructField("CODE", T.StringType()), T.StructField("MESSAGE", T.StringType())])


def envelope(dataset: str, row: T.StructType) -> T.StructType:
    """An answer of the web source: a root RESULT, or dataset as [{head}, {row}]."""
    head = T.StructType([T.StructField("list_total_count", T.LongType()), T.StructField("RESULT", RESULT)])
    both = T.StructType([T.StructField("head", T.ArrayType(head)), T.StructField("row", T.ArrayType(row))])
    return T.StructType([T.StructField("RESULT", RESULT), T.StructField(dataset, T.ArrayType(both))])


SNAPSHOT = T.StructType([
    T.StructField("metadata", T.StructType([*(T.StructField(c, T.StringType()) for c in ("school_name", "office_code", "school_code", "source", "query_start", "query_end", "fetched_at_utc")), T.StructField("row_count", T.LongType())])),
    T.StructField("rows", T.ArrayType(RAW)),
])

_CLEAN = [T.DateType(), T.StringType(), T.StringType(), T.ArrayType(T.StringType()), T.StringType(), T.ArrayType(T.IntegerType()), *[T.DoubleType()] * 4, T.IntegerType()]
CLEAN = T.StructType([T.StructField(n, t) for n, t in zip(CLEAN_COLUMNS, _CLEAN, strict=True)])

MANIFEST = T.StructType([T.StructField("documents", T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("title", "file", "source_path", "source_url", "download_url", "sha256")])))])
