"""Raw meals made from the orders tables: one row per order that has lines, with markup, codes and units in texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.clean import cleaned

KEY = "row_id"
LINES = 500_000  # lines a task of the joins; only the plan depends on it


def spread(spark, lines: DataFrame):
    """Deals a table by a key into as many tasks as these lines need, so that no task's share grows with the tables. A session
    with that many shuffle partitions is left to its own. A join's other side follows the number of the side dealt."""
    n = -(-lines.count() // LINES)
    return (lambda df, key: df.repartition(n, key)) if n > int(spark.conf.get("spark.sql.shuffle.partitions")) else (lambda df, key: df)


def raw_meals(spark, sf_dir: str) -> DataFrame:
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    dealt = spread(spark, t("lineitem"))
    part = dealt(t("part").select("p_partkey", "p_name"), "p_partkey")
    lines = t("lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    dish = F.concat("p_name", F.lit(" ("), (F.col("l_partkey") % 20).cast("string"), F.lit("."), (F.col("l_suppkey") % 19 + 1).cast("string"), F.lit(")"))
    lines = lines.select("l_orderkey", dish.alias("dish"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    menus = dealt(lines, "l_orderkey").groupBy("l_orderkey").agg(F.expr("listagg(dish, '<br/>') within group (order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)").alias("DDISH_NM"), F.sum(F.col("l_quantity").cast("bigint")).alias("s"))
    who = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    who = dealt(who, "c_custkey")
    orders = t("orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority").join(who, F.col("o_custkey") == F.col("c_custkey"))
    both = orders.join(menus, F.col("o_orderkey") == F.col("l_orderkey"))
    text = lambda c: c.cast("string")
    s = F.col("s")
    fat = F.when(s % 7 == 0, "-").otherwise(text(s % 30))
    return both.select(
        F.col("o_orderkey").alias(KEY), F.date_format("o_orderdate", "yyyyMMdd").alias("MLSV_YMD"), F.col("n_name").alias("SCHUL_NM"), F.col("o_orderpriority").alias("MMEAL_SC_NM"), "DDISH_NM",
        F.concat(text(s * 10), F.lit(".5 Kcal")).alias("CAL_INFO"),
        F.concat(F.lit("탄수화물(g) : "), text(s % 150), F.lit(".5<br/>단백질(g) : "), text(s % 40), F.lit("<br/>지방(g) : "), fat).alias("NTR_INFO"),
    )


def clean_meals(spark, sf_dir: str) -> DataFrame:
    return cleaned(raw_meals(spark, sf_dir), (KEY,))


RAW_SQL = """
raw as (select o_orderkey row_id, strftime(o_orderdate, '%Y%m%d') MLSV_YMD, n_name SCHUL_NM, o_orderpriority MMEAL_SC_NM, DDISH_NM, (s * 10)::varchar || '.5 Kcal' CAL_INFO,
  '탄수화물(g) : ' || (s % 150)::varchar || '.5<br/>단백질(g) : ' || (s % 40)::varchar || '<br/>지방(g) : ' || case when s % 7 = 0 then '-' else (s % 30)::varchar end NTR_INFO
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join (
    select l_orderkey, sum(l_quantity::bigint)::bigint s, string_agg(p_name || ' (' || (l_partkey % 20)::varchar || '.' || (l_suppkey % 19 + 1)::varchar || ')', '<br/>' order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) DDISH_NM
    from lineitem join part on l_partkey = p_partkey group by l_orderkey) on l_orderkey = o_orderkey)"""

DISHES_SQL = r"list_filter(list_transform(regexp_split_to_array({x}, '(?i)<br\s*/?>'), lambda p: trim(regexp_replace(regexp_replace(p, '\([0-9]{{1,2}}(\.[0-9]{{1,2}})*\)', '', 'g'), '\s+', ' ', 'g'))), lambda p: p <> '')"
CODES_SQL = r"list_sort(list_distinct(flatten(list_filter(list_transform(regexp_extract_all({x}, '\(([0-9]{{1,2}}(?:\.[0-9]{{1,2}})*)\)', 1), lambda g: list_transform(string_split(g, '.'), lambda c: c::int)), lambda a: len(list_filter(a, lambda c: c < 1 or c > 19)) = 0))))"
NUTRIENT_SQL = r"try_cast(nullif(regexp_extract(NTR_INFO, '{label}\s*\(g\)\s*:\s*(-?[0-9]+(?:\.[0-9]+)?)', 1), '') as double)"

CLEAN_SQL = f"""{RAW_SQL},
clean0 as (select row_id, strptime(MLSV_YMD, '%Y%m%d')::date date, SCHUL_NM school_name, MMEAL_SC_NM meal_type, {DISHES_SQL.format(x='DDISH_NM')} dishes, {CODES_SQL.format(x='DDISH_NM')} allergy_codes,
  try_cast(nullif(regexp_extract(CAL_INFO, '-?[0-9]+(?:\\.[0-9]+)?'), '') as double) calories, {NUTRIENT_SQL.format(label='탄수화물')} carbs_g, {NUTRIENT_SQL.format(label='단백질')} protein_g, {NUTRIENT_SQL.format(label='지방')} fat_g from raw),
clean as (select *, array_to_string(dishes, ' ') menu_text, len(dishes)::int dish_count from clean0 where date is not null and len(dishes) > 0)"""
