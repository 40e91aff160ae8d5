"""Reports and sinks: the result table, the summary, table profiles, rule checks, snapshots."""

from __future__ import annotations

from math import ceil, floor

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import text as X
from .kmeans import Bracket, selected
from .recommend import Profile, Ranking, Rules
from .steps import written


def result_table(ranked: DataFrame, key: str) -> DataFrame:
    """The seven columns of the report; ranked holds a few rows."""
    rank = F.row_number().over(W.orderBy(F.desc("score"), "date", key))
    values = [rank, F.date_format("date", "yyyy-MM-dd"), F.col("score"), F.col("menu_text"), F.col("reason"), F.col("cluster_name"), X.listed_codes(F.col("allergy_codes"), C.NO_CODES)]
    return ranked.select(*(v.alias(n) for v, n in zip(values, C.RESULT_COLUMNS, strict=True)))


def run_recommendation(rows: DataFrame, key: str, *, likes_text="", avoids_text="", preferred_types=(), spice_level=2, allergy_codes=(), top=3, rules: Rules | None = None) -> tuple[str, DataFrame]:
    """Form texts to (summary, result table)."""
    terms = lambda t: tuple(p for p in (s.strip() for s in str(t or "").split(",")) if p)
    profile = Profile(terms(likes_text), terms(avoids_text), tuple(preferred_types or ()), int(spice_level), tuple(int(c) for c in (allergy_codes or ())))
    if top < 1:
        raise ValueError("top must be at least 1")
    ranking = Ranking(rows, key, {"": profile}, rules)  # counts the excluded rows in its own pass over rows
    ranked = written(ranking.best(top).drop("profile", "rank"))
    told = {"shown": ranked.count(), "excluded": ranking.excluded[""], "notice": C.SAFETY_NOTICE}
    return (C.SUMMARY if told["shown"] else C.ALL_EXCLUDED).format(**told), result_table(ranked, key)


def null_counts(df: DataFrame) -> DataFrame:
    """column, nulls."""
    one = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in df.columns))
    return one.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, df.columns)), F.array(*df.columns))).alias("column", "nulls"))


def described(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, count, mean, std (of a sample), min, exact quartiles, max, to one digit. Quartiles are found by distributed
    selection, so that no task holds a column's values."""
    counts, quarters = df.agg(*(F.count(c).alias(c) for c in columns)).first(), (0.25, 0.5, 0.75)
    places = [(c, q, (counts[c] - 1) * q) for c in columns if counts[c] for q in quarters]
    asked = [Bracket(F.col(c).isNotNull(), [F.col(c)], p, counts[c]) for c, _, at in places for p in (floor(at), ceil(at))]
    got = iter(selected(df.select(*columns), asked, columns) if asked else ())
    known = {(c, q): _between(float(next(got)[c]), float(next(got)[c]), at) for c, q, at in places}
    stat = lambda c: F.struct(
        F.lit(c).alias("column"), F.count(c).alias("count"), F.round(F.avg(c), 1).alias("mean"), F.round(F.stddev_samp(c), 1).alias("std"), F.round(F.min(c), 1).alias("min"),
        *(F.round(F.lit(known.get((c, q))).cast("double"), 1).alias(n) for q, n in zip(quarters, ("q1", "q2", "q3"))), F.round(F.max(c), 1).alias("max"),
    )
    return df.agg(F.array(*map(stat, columns)).alias("all")).select(F.inline("all"))


def _between(low: float, high: float, at: float) -> float:
    """The value at a place between two rows."""
    return low if low == high else (ceil(at) - at) * low + (at - floor(at)) * high


def rule_checks(ranked: DataFrame, checks: dict) -> DataFrame:
    """name, passed: whether every row meets each condition (true without rows)."""
    one = ranked.agg(*(F.coalesce(F.bool_and(c), F.lit(True)).alias(n) for n, c in checks.items()))
    return one.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, checks)), F.array(*checks))).alias("name", "passed"))


def run_summary(runs: DataFrame) -> DataFrame:
    """passed, failed and total_seconds of rows with status and seconds."""
    return runs.agg(F.count_if(F.col("status") == "PASS").alias("passed"), F.count_if(F.col("status") != "PASS").alias("failed"), F.round(F.sum("seconds"), 2).alias("total_seconds"))


def head(df: DataFrame, order: list, n: int = 5) -> DataFrame:
    """The first n rows of an order; each task keeps n at most."""
    return df.orderBy(*order).limit(n)


def console(df: DataFrame, order: list, n: int = 5) -> str:
    """The first n rows as a table of text."""
    return head(df, order, n).toPandas().to_string(index=False)


def model_card(facts: DataFrame, entries: dict) -> DataFrame:
    """key, value: a card whose entries are columns over a table of one row, as texts."""
    pairs = F.map_from_arrays(F.array(*map(F.lit, entries)), F.array(*(c.cast("string") for c in entries.values())))
    return facts.select(F.explode(pairs).alias("key", "value"))


def card_faults(card: DataFrame, needed: list[str]) -> DataFrame:
    """key, fault: needed entries that a card lacks or leaves empty, and entries it has twice. None: the card is complete."""
    listed = card.sparkSession.createDataFrame([(k,) for k in needed], "key string")
    held = card.groupBy("key").agg(F.count("*").alias("n"), F.count_if(F.trim(F.coalesce("value", F.lit(""))) == "").alias("empty"))
    fault = F.when(F.col("n").isNull(), "missing").when(F.col("empty") > 0, "empty").when(F.col("n") > 1, "twice")
    return listed.join(held, "key", "full").select("key", fault.alias("fault")).filter("fault is not null")


def marked_results(lines: DataFrame, marker: str, schema: str) -> DataFrame:
    """The last line of each source that begins with marker, its rest parsed as JSON. lines: source, pos, value."""
    found = lines.filter(F.col("value").startswith(marker))
    last = found.groupBy("source").agg(F.max_by("value", "pos").alias("value"))
    return last.select("source", F.from_json(F.substring("value", len(marker) + 1, 1 << 30), schema).alias("result"))


def write_snapshot(raw: DataFrame, path: str, metadata: dict, least: int = 5) -> int:
    """Lunch rows as one JSON object {metadata, rows}; ValueError with fewer than `least`. A snapshot is one small
    document by its format: metadata names one school and period."""
    lunch = raw.filter(F.col("MMEAL_SC_NM") == C.LUNCH)
    n = lunch.count()
    if n < least:
        raise ValueError(f"{n} rows; a snapshot needs {least}")
    known = F.struct(*(F.lit(v).alias(k) for k, v in {**metadata, "row_count": n}.items() if v is not None), *([] if "fetched_at_utc" in metadata else [X.utc_stamp(F.current_timestamp()).alias("fetched_at_utc")]))
    lunch.agg(F.collect_list(F.struct(*lunch.columns)).alias("rows")).select(known.alias("metadata"), "rows").coalesce(1).write.mode("overwrite").json(path)
    return n
