"""Queries by name and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import text as X
from ..functions.rounding import round1
from ..operators import kmeans, report, steps, tfidf, zipping
from ..operators import recommend as R
from ..operators.clean import cleaned, in_range, without_codes
from ..schemas import RAW
from ..sources import files, reports, web
from . import oracle as O
from .meals_view import CLEAN_SQL, CODES_SQL, DISHES_SQL, KEY, NUTRIENT_SQL, RAW_SQL, clean_meals, raw_meals

FLAGSHIP = "recommend_topk"
QUERIES: dict = {}
SQL: dict = {}

RULES = R.Rules(
    types={"metal": ["bolt", "rod"], "round": ["ring", "gear"], "flat": ["plate"], "heavy": ["anvil"], "toy": ["gizmo", "widget"]},
    spice={5: ["hot"], 4: ["red"], 3: ["large", "cold"]},
)
FIRST = R.Profile(("red bolt", "gear"), ("anvil",), ("round", "flat"), 3, (7, 11))
SECOND = R.Profile(("widget",), ("small rod",), ("toy",), 5, (3,))
PLAIN = R.Profile(spice_level=2)
TOP = 25
# Frequent words of the prose, as stop words.
STOP = ["the", "of", "and", "in", "to", "is", "on", "that", "la", "le", "de", "der", "die", "und", "que"]
MENU = ["row_id", "date", "menu_text", "score", "cluster_name", "reason"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


# ---- cleaning -------------------------------------------------------------------------------------------------------

_HTML = "replace(replace(replace(replace(replace(replace(html, '&middot;', '·'), '&copy;', '©'), '&quot;', '\"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"


@query(f"select page_id, len(d)::int as n_parts, array_to_string(d, '|') as parts from (select page_id, {DISHES_SQL.format(x=_HTML)} d from pages)")
def html_break_split(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", X.dishes(F.col("html")).alias("d")).select("page_id", F.size("d").alias("n_parts"), F.array_join("d", "|").alias("parts"))


@query(f"with {RAW_SQL} select row_id, array_to_string({CODES_SQL.format(x='DDISH_NM')}, ',') as codes from raw")
def code_extract(spark, sf_dir):
    return raw_meals(spark, sf_dir).select(KEY, joined(X.codes(F.col("DDISH_NM"))).alias("codes"))


@query(f"with {RAW_SQL} select row_id, try_cast(nullif(regexp_extract(CAL_INFO, '-?[0-9]+(?:\\.[0-9]+)?'), '') as double) as calories from raw")
def number_extract(spark, sf_dir):
    return raw_meals(spark, sf_dir).select(KEY, X.first_number(F.col("CAL_INFO")).alias("calories"))


@query(f"with {RAW_SQL} select row_id, {NUTRIENT_SQL.format(label='탄수화물')} as carbs_g, {NUTRIENT_SQL.format(label='단백질')} as protein_g, {NUTRIENT_SQL.format(label='지방')} as fat_g from raw")
def nutrient_extract(spark, sf_dir):
    return raw_meals(spark, sf_dir).select(KEY, *(X.nutrient(F.col("NTR_INFO"), n).alias(n) for n in C.NUTRIENTS))


@query("select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day, null::varchar as bad from orders")
def date_normalise(spark, sf_dir):
    iso = lambda c: F.date_format(X.compact_date(c), "yyyy-MM-dd")
    return t(spark, sf_dir, "orders").select("o_orderkey", iso(F.date_format("o_orderdate", "yyyyMMdd")).alias("day"), iso(F.date_format("o_orderdate", "yyyy1399")).alias("bad"))


@query(f"with {RAW_SQL} select row_id, MLSV_YMD from raw where coalesce(MLSV_YMD, '') between '19960101' and '19960630'")
def date_range_filter(spark, sf_dir):
    return in_range(raw_meals(spark, sf_dir), "19960101", "19960630").select(KEY, "MLSV_YMD")


@query(f"with {CLEAN_SQL} select row_id, strftime(date, '%Y-%m-%d') as day, school_name, meal_type, array_to_string(dishes, '|') as dishes, menu_text, array_to_string(allergy_codes, ',') as codes, calories, carbs_g, protein_g, fat_g, dish_count from clean")
def meals_clean(spark, sf_dir):
    rows = clean_meals(spark, sf_dir)
    return rows.select(KEY, F.date_format("date", "yyyy-MM-dd").alias("day"), "school_name", "meal_type", F.array_join("dishes", "|").alias("dishes"), "menu_text", joined("allergy_codes").alias("codes"), "calories", "carbs_g", "protein_g", "fat_g", "dish_count")


@query("select event_id, (props->>'$.k')::bigint as k, strlen(props)::bigint as n from events")
def json_path(spark, sf_dir):
    k = F.expr("try_variant_get(parse_json(props), '$.k', 'bigint')")
    return t(spark, sf_dir, "events").select("event_id", k.alias("k"), F.octet_length("props").cast("bigint").alias("n"))


@query("select strftime(o.o_orderdate, '%Y%m%d') as day, o.o_orderpriority as meal_type, count(*) as n, max(c) as total from orders o join (select o_custkey % 50 page, count(*) c from orders group by 1) p on p.page = o.o_custkey % 50 group by all")
def envelope_unnest(spark, sf_dir):
    orders = t(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("page"), F.struct(F.date_format("o_orderdate", "yyyyMMdd").alias("MLSV_YMD"), F.col("o_orderpriority").alias("MMEAL_SC_NM")).alias("r"))
    pages = orders.groupBy("page").agg(F.collect_list("r").alias("row"), F.count("*").alias("n"))
    head = F.struct(F.array(F.struct(F.col("n").alias("list_total_count"), F.lit(None).cast("struct<CODE:string,MESSAGE:string>").alias("RESULT")), F.struct(F.lit(None).cast("bigint").alias("list_total_count"), F.struct(F.lit("INFO-000").alias("CODE"), F.lit("ok").alias("MESSAGE")).alias("RESULT"))).alias("head"), F.lit(None).cast("array<struct<MLSV_YMD:string,MMEAL_SC_NM:string>>").alias("row"))
    body = F.struct(F.lit(None).cast("array<struct<list_total_count:bigint,RESULT:struct<CODE:string,MESSAGE:string>>>").alias("head"), F.col("row"))
    answers = pages.select(F.to_json(F.struct(F.array(head, body).alias(web.MEALS))).alias("answer"))
    totals = answers.select("answer", web.total_count(F.col("answer"), web.MEALS, RAW).alias("total"))
    rows = totals.select("total", F.from_json("answer", f"{web.MEALS} array<struct<row:array<struct<MLSV_YMD:string,MMEAL_SC_NM:string>>>>").alias("a")).select("total", F.inline(F.expr(f"a.{web.MEALS}[1].row")))
    return rows.groupBy(F.col("MLSV_YMD").alias("day"), F.col("MMEAL_SC_NM").alias("meal_type")).agg(F.count("*").alias("n"), F.max("total").alias("total"))


@query(f"with {CLEAN_SQL} select row_id, array_to_string(allergy_codes, ',') as codes from clean where not list_has_any(allergy_codes, [5, 9])")
def allergen_antifilter(spark, sf_dir):
    return without_codes(clean_meals(spark, sf_dir), [5, 9]).select(KEY, joined("allergy_codes").alias("codes"))


@query(f"with {CLEAN_SQL} select count(*) as excluded from clean where list_has_any(allergy_codes, [5, 9])")
def excluded_count(spark, sf_dir):
    codes = F.lit([5, 9]).cast("array<int>")
    return clean_meals(spark, sf_dir).agg(F.count_if(F.arrays_overlap("allergy_codes", codes)).alias("excluded"))


@query(f"with {RAW_SQL} select row_id, array_to_string(regexp_extract_all(NTR_INFO, '[가-힣]{{2,}}'), '|') as words from raw")
def hangul_words(spark, sf_dir):
    return raw_meals(spark, sf_dir).select(KEY, F.array_join(X.hangul_words(F.col("NTR_INFO")), "|").alias("words"))


@query("select o_orderkey, replace(strftime(o_orderdate, '%Y-%m-%d'), '-', '') as compact from orders")
def hyphen_removal(spark, sf_dir):
    return t(spark, sf_dir, "orders").select("o_orderkey", X.without_hyphens(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("compact"))


@query("""select strftime(o_orderdate, '%Y-%m-%d') as day, case when o_custkey % 5 = 0 then null else o_orderpriority end as meal_type, count(*) as n from orders
where o_custkey % 7 <> 0 and o_custkey % 11 <> 0 group by all""")
def stored_answers(spark, sf_dir):
    """Rows in stored answers of the web source: pages with rows, and some that say that there are none."""
    day, kind = F.date_format("o_orderdate", "yyyy-MM-dd").alias("MLSV_YMD"), F.when(F.col("o_custkey") % 5 != 0, F.col("o_orderpriority")).alias("MMEAL_SC_NM")
    told = lambda code: F.struct(F.lit(code).alias("CODE"), F.lit("x").alias("MESSAGE"))
    row = F.struct(day, kind)
    whole = F.to_json(F.struct(F.array(F.struct(F.array(F.struct(told(web.OK).alias("RESULT"))).alias("head"), F.lit(None).cast("array<struct<MLSV_YMD:string,MMEAL_SC_NM:string>>").alias("row")), F.struct(F.lit(None).cast("array<struct<RESULT:struct<CODE:string,MESSAGE:string>>>").alias("head"), F.array(row).alias("row"))).alias(web.MEALS)))
    none = F.to_json(F.struct(told(web.NONE).alias("RESULT")))
    key = F.col("o_custkey")
    answers = t(spark, sf_dir, "orders").select(F.when((key % 7 == 0) | (key % 11 == 0), none).otherwise(whole).alias("answer"))
    rows = web.unnested(answers, "answer", web.MEALS, RAW)
    return rows.groupBy(F.col("MLSV_YMD").alias("day"), F.col("MMEAL_SC_NM").alias("meal_type")).agg(F.count("*").alias("n"))


@query(f"with {RAW_SQL} select row_id, MLSV_YMD from raw where row_id % 3 <> 0 and row_id % 5 <> 0")
def incomplete_rejected(spark, sf_dir):
    """Rows without a real date or a dish are rejected by cleaning."""
    raw = raw_meals(spark, sf_dir).withColumn("MLSV_YMD", F.when(F.col(KEY) % 3 == 0, "19991399").otherwise(F.col("MLSV_YMD"))).withColumn("DDISH_NM", F.when(F.col(KEY) % 5 == 0, " <br/> (1.2)").otherwise(F.col("DDISH_NM")))
    return cleaned(raw, (KEY,)).select(KEY, F.date_format("date", "yyyyMMdd").alias("MLSV_YMD"))


# ---- keywords -------------------------------------------------------------------------------------------------------


@query(f"select p_partkey, array_to_string({O.case_types('p_name', RULES.types)}, ',') as classes from part")
def keyword_class(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", F.array_join(X.menu_types(F.col("p_name"), RULES.types), ",").alias("classes"))


@query(f"select p_partkey, {O.case_spice('p_name', RULES.spice)} as level from part")
def spice_level(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", X.spice_level(F.col("p_name"), RULES.spice).alias("level"))


@query("select n_nationkey, array_to_string(list_filter(list_transform(string_split(n_name || ' ,, x , ' || n_name, ','), lambda x: trim(x)), lambda x: x <> ''), '|') as terms from nation")
def csv_terms(spark, sf_dir):
    return t(spark, sf_dir, "nation").select("n_nationkey", F.array_join(X.csv_terms(F.concat("n_name", F.lit(" ,, x , "), "n_name")), "|").alias("terms"))


@query("select n_nationkey, case when n_name = 'x' then 'x' else n_name || '|x' end as terms from nation")
def ordered_distinct(spark, sf_dir):
    return t(spark, sf_dir, "nation").select("n_nationkey", F.array_join(X.ordered_distinct(F.array("n_name", F.lit(" "), F.lit("x "), F.concat(F.lit(" "), F.col("n_name")), F.lit("x"))), "|").alias("terms"))


# ---- text statistics ------------------------------------------------------------------------------------------------

_PART_GRAMS = f"g as (select p_partkey k, term, count(*) n from (select p_partkey, unnest({O.grams('p_name')}) term from part) group by all)"


@query(f"with {_PART_GRAMS} select k as p_partkey, term, n from g")
def char_ngrams(spark, sf_dir):
    return tfidf.term_counts(t(spark, sf_dir, "part"), "p_partkey", X.char_grams(F.col("p_name")))


@query(f"with {_PART_GRAMS} select term, count(*) as df from g group by term")
def doc_frequency(spark, sf_dir):
    return tfidf.document_frequency(char_ngrams(spark, sf_dir))


@query(f"with {_PART_GRAMS}, d as (select term, count(*) df from g group by term), s as (select k, sum(n) s from g group by k) select g.k as p_partkey, g.term, round(n / s, 6) as tf, round(ln((1 + (select count(*) from part)) / (1 + df)) + 1, 6) as idf, round(n / s * (ln((1 + (select count(*) from part)) / (1 + df)) + 1), 6) as tfidf from g join d on d.term = g.term join s on s.k = g.k")
def idf(spark, sf_dir):
    part = t(spark, sf_dir, "part")
    out = tfidf.tfidf_of(part, "p_partkey", X.char_grams(F.col("p_name")), part.count())
    return out.select("p_partkey", "term", *(F.round(c, 6).alias(c) for c in ("tf", "idf", "tfidf")))


_ASKED = "hot gizmo plate zebra"


@query(f"with {O.similarity('part', 'p_partkey', 'p_name', _ASKED, 'sim')} select k as p_partkey, round(similarity, 6) as similarity from sim")
def tfidf_search(spark, sf_dir):
    out = tfidf.similarity(t(spark, sf_dir, "part"), "p_partkey", "p_name", _ASKED)
    return out.select("p_partkey", F.round("similarity", 6).alias("similarity"))


@query(f"with {O.similarity('benchmark', 'item_id', 'text', 'the of and inter', 'sim')} select k as item_id, round(similarity, 6) as similarity from sim order by 2 desc, 1 limit 1")
def topk_similar_one(spark, sf_dir):
    return tfidf.most_similar(t(spark, sf_dir, "benchmark"), "item_id", "text", "the of and inter")


@query(f"""with w as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{{2,}}')) term from documents),
c as (select doc_id, term, count(*) n from w where term not in ({", ".join(f"'{x}'" for x in STOP)}) group by all),
d as (select term, count(*) df from c group by term), s as (select doc_id, sum(n) s from c group by doc_id),
v as (select c.doc_id, c.term, n, df, round(n / s * (ln((1 + (select count(*) from documents)) / (1 + df)) + 1), 6) tfidf from c join d on d.term = c.term join s on s.doc_id = c.doc_id)
select doc_id, row_number() over (partition by doc_id order by tfidf desc, term)::int as rank, term, n, df, tfidf from v qualify rank <= 8""")
def keyword_top8(spark, sf_dir):
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{2,}"), F.lit(0))
    return tfidf.keywords(t(spark, sf_dir, "documents"), "doc_id", words, STOP)


@query("with w as (select unnest(regexp_extract_all(lower(text), '[a-z]{2,}')) term from benchmark) select distinct term from w")
def vocabulary(spark, sf_dir):
    return t(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{2,}"), F.lit(0))).alias("term")).distinct()


# ---- numbers --------------------------------------------------------------------------------------------------------

_PART_FEATURES = ["p_retailprice", "p_size", "p_partkey % 37", "p_partkey % 101", "length(p_name)"]
_PART_SOURCE = f"pf as (select p_partkey k, {', '.join(f'case when p_partkey % {11 + i} = 0 then null else ({f})::double end f{i}' for i, f in enumerate(_PART_FEATURES))} from part)"
_F = [f"f{i}" for i in range(5)]


def part_features(spark, sf_dir):
    return t(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), *(F.expr(f"case when p_partkey % {11 + i} = 0 then null else cast({f} as double) end").alias(f"f{i}") for i, f in enumerate(_PART_FEATURES)))


_KM = O.clusters("pf", "k", _F, 3, "km")


@query(f"with {_PART_SOURCE}, {O.clusters('pf', 'k', _F, 3, 'km', 1)} select k, {', '.join(f'round(x{i}, 6) as {f}' for i, f in enumerate(_F))} from km_x")
def impute_median(spark, sf_dir):
    made, _ = kmeans.imputed(part_features(spark, sf_dir), "k", _F)
    return made.select("k", *(F.round(F.get("x", F.lit(i)), 6).alias(f) for i, f in enumerate(_F)))


@query(f"with {_PART_SOURCE}, {O.clusters('pf', 'k', _F, 3, 'km', 1)} select k, {', '.join(f'round(z{i}, 6) as {f}' for i, f in enumerate(_F))} from km_z")
def zscore(spark, sf_dir):
    made, _ = kmeans.imputed(part_features(spark, sf_dir), "k", _F)
    return made.select("k", *(F.round(F.get("z", F.lit(i)), 6).alias(f) for i, f in enumerate(_F)))


@query(f"with {_PART_SOURCE}, {O.clusters('pf', 'k', _F, 3, 'km', 1)} select g as seed, {', '.join(f'round(v{i}, 6) as {f}' for i, f in enumerate(_F))} from km_0")
def kmeans_seed(spark, sf_dir):
    made, told = kmeans.imputed(part_features(spark, sf_dir), "k", _F)
    ordered = made.select(F.get("x", F.lit(0)).alias("c"), "k", "z")
    places = [round(i * (told["n"] - 1) / 2) for i in range(3)]
    seeds = [(i, *(round(v, 6) for v in r["z"])) for i, r in enumerate(kmeans.at_positions(ordered, ["c", "k"], places))]
    return spark.createDataFrame(seeds, "seed int, " + ", ".join(f"{f} double" for f in _F))


@query(f"with {_PART_SOURCE}, {_KM} select k, cluster_name from km")
def kmeans_labels(spark, sf_dir):
    return kmeans.labelled(part_features(spark, sf_dir), "k", 3, _F).select("k", "cluster_name")


@query(f"with {_PART_SOURCE} select unnest(['f0', 'f1', 'f2', 'f3', 'f4']) as \"column\", unnest([{', '.join(f'count(*) - count({f})' for f in _F)}]) as nulls from pf")
def null_counts(spark, sf_dir):
    return report.null_counts(part_features(spark, sf_dir).select(*_F))


@query("select 'o_totalprice' as \"column\", count(o_totalprice) as count, round(avg(o_totalprice), 1) as mean, round(stddev_samp(o_totalprice), 1) as std, round(min(o_totalprice), 1) as min, round(quantile_cont(o_totalprice, 0.25), 1) as q1, round(quantile_cont(o_totalprice, 0.5), 1) as q2, round(quantile_cont(o_totalprice, 0.75), 1) as q3, round(max(o_totalprice), 1) as max from orders")
def describe_stats(spark, sf_dir):
    return report.described(t(spark, sf_dir, "orders"), ["o_totalprice"])


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, ((k + (case when d > 0.5 or (d = 0.5 and k % 2 = 1) then 1 else 0 end))::double / 10::double) as rounded from (select l_orderkey, l_linenumber, l_partkey, l_suppkey, floor(v)::bigint k, v - floor(v) d from (select *, (l_quantity / 4)::double * 10 v from lineitem))")
def exact_rounding(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", round1(F.col("l_quantity") / 4).alias("rounded"))


# ---- ranking --------------------------------------------------------------------------------------------------------

_MENU_SQL = "row_id, strftime(date, '%Y-%m-%d') as date, menu_text, score, cluster_name, reason"


def menu(df, *more):
    return df.withColumn("date", F.date_format("date", "yyyy-MM-dd")).select(*more, *MENU)


@query(f"with {CLEAN_SQL}, {O.ranking('clean', KEY, FIRST, RULES, 'a', TOP)} select {_MENU_SQL} from a")
def recommend_topk(spark, sf_dir):
    return menu(R.recommend(clean_meals(spark, sf_dir), KEY, FIRST, TOP, RULES))


@query(f"with {CLEAN_SQL}, {O.ranking('clean', KEY, FIRST, RULES, 'a', 10)}, {O.ranking('clean', KEY, SECOND, RULES, 'b', 10)} select 'first' as profile, rank::int as rank, {_MENU_SQL} from a union all select 'second', rank::int, {_MENU_SQL} from b")
def recommend_two_profiles(spark, sf_dir):
    return menu(R.batch(clean_meals(spark, sf_dir), KEY, {"first": FIRST, "second": SECOND}, 10, RULES), "profile", "rank")


_WARM = R.replace(FIRST, spice_level=5, allergy_codes=())


@query(f"with {CLEAN_SQL}, {O.ranking('clean', KEY, FIRST, RULES, 'a', 1)}, {O.ranking('clean', KEY, _WARM, RULES, 'b', 1)} select 'before' as profile, {_MENU_SQL} from a union all select 'after', {_MENU_SQL} from b")
def what_if(spark, sf_dir):
    return menu(R.what_if(clean_meals(spark, sf_dir), KEY, FIRST, RULES, spice_level=5, allergy_codes=()), "profile")


@query(f"with {CLEAN_SQL}, {O.ranking('clean', KEY, SECOND, RULES, 'a', 3)} select rank::int as \"순위\", strftime(date, '%Y-%m-%d') as \"날짜\", score as \"추천 점수\", menu_text as \"메뉴\", reason as \"추천 이유\", cluster_name as \"식단 군집\", case when len(allergy_codes) = 0 then '{C.NO_CODES}' else array_to_string(allergy_codes, ', ') end as \"알레르기 번호\" from a")
def result_table(spark, sf_dir):
    return report.result_table(R.recommend(clean_meals(spark, sf_dir), KEY, SECOND, 3, RULES), KEY)


@query(f"with {CLEAN_SQL}, {O.ranking('clean', KEY, R.replace(PLAIN, spice_level=3), RULES, 'a', 10**12)} select unnest(['in_range', 'has_reason', 'neutral', 'top']) as name, unnest([bool_and(score between 0 and 100), bool_and(length(reason) > 0), bool_and(score <= 20), bool_and(score >= 20)]) as passed from a")
def score_bounds(spark, sf_dir):
    rows = R.scored(clean_meals(spark, sf_dir), KEY, R.replace(PLAIN, spice_level=3), RULES)
    return report.rule_checks(rows, {"in_range": F.col("score").between(0, 100), "has_reason": F.length("reason") > 0, "neutral": F.col("score") <= 20.0, "top": F.col("score") >= 20.0})


@query("select count_if(event_type = 'click')::bigint as passed, count_if(event_type <> 'click')::bigint as failed, round(sum(value), 2) as total_seconds from events")
def dq_summary(spark, sf_dir):
    runs = t(spark, sf_dir, "events").select(F.when(F.col("event_type") == "click", "PASS").otherwise("FAIL").alias("status"), F.col("value").alias("seconds"))
    return report.run_summary(runs)


@query(f"with {CLEAN_SQL} select strftime(date, '%Y-%m-%d') as day, round(avg(calories), 6) as calories from clean group by date")
def calories_by_date(spark, sf_dir):
    return clean_meals(spark, sf_dir).groupBy(F.date_format("date", "yyyy-MM-dd").alias("day")).agg(F.round(F.avg("calories"), 6).alias("calories"))


@query("select user_id, arg_max(props, (ts, event_id)) as props from events group by user_id")
def last_marked(spark, sf_dir):
    lines = t(spark, sf_dir, "events").select(F.col("user_id").alias("source"), F.struct("ts", "event_id").alias("pos"), F.concat(F.lit("RESULT="), "props").alias("value"))
    return report.marked_results(lines, "RESULT=", "k bigint").select(F.col("source").alias("user_id"), F.to_json("result").alias("props")).withColumn("props", F.replace("props", F.lit(":"), F.lit(": ")))


@query("select doc_id, sha256(text) as sha, length(text) = n_chars as same, length(text)::int as n, substr(text, 1, 80) as head from documents")
def sha256_verify(spark, sf_dir):
    sha = F.sha2(F.col("text").cast("binary"), 256)
    return t(spark, sf_dir, "documents").select("doc_id", sha.alias("sha"), (F.length("text") == F.col("n_chars")).alias("same"), F.length("text").alias("n"), F.substring("text", 1, 80).alias("head"))


@query("select url[: instr(url, '://') - 1] as scheme, page_id, 'page=' || page_id || '&q=a+b' as request from pages")
def request_preview(spark, sf_dir):
    params = F.create_map(F.lit("page"), F.col("page_id").cast("string"), F.lit("KEY"), F.lit("secret"), F.lit("q"), F.lit("a b"))
    request = F.substring_index(web.shown_url(F.col("url"), params), "?", -1)
    return t(spark, sf_dir, "pages").select(F.substring_index("url", "://", 1).alias("scheme"), "page_id", request.alias("request"))


@query("select o_custkey, o_orderkey, page, total, kind from (select o_custkey, o_orderkey, o_orderpriority kind, (row_number() over (partition by o_custkey order by o_orderkey) - 1) // 10 + 1 page, count(*) over (partition by o_custkey) total from orders)")
def school_pages(spark, sf_dir):
    """Answers of a paged source, made of orders: a customer is a school with pages of 10. Rows and totals are read from them."""
    own = W.partitionBy("o_custkey")
    rows = t(spark, sf_dir, "orders").select("o_custkey", F.struct(F.col("o_orderkey").cast("string").alias("MLSV_YMD"), F.col("o_orderpriority").alias("MMEAL_SC_NM")).alias("r"), "o_orderkey")
    rows = rows.withColumn("page", F.floor((F.row_number().over(own.orderBy("o_orderkey")) - 1) / 10) + 1).withColumn("total", F.count("*").over(own))
    pages = rows.groupBy("o_custkey", "page").agg(F.first("total").alias("total"), F.collect_list("r").alias("row"))  # 10 at most
    told = F.struct(F.lit(web.OK).alias("CODE"), F.lit("ok").alias("MESSAGE"))
    head = F.struct(F.array(F.struct(F.col("total").alias("list_total_count"), told.alias("RESULT"))).alias("head"), F.lit(None).cast("array<struct<MLSV_YMD:string,MMEAL_SC_NM:string>>").alias("row"))
    body = F.struct(F.lit(None).cast("array<struct<list_total_count:bigint,RESULT:struct<CODE:string,MESSAGE:string>>>").alias("head"), F.col("row"))
    answers = pages.select("o_custkey", "page", F.to_json(F.struct(F.array(head, body).alias(web.MEALS))).alias("answer"))
    told = answers.select("o_custkey", "page", web.total_count(F.col("answer"), web.MEALS, RAW).alias("total"), web.rows_in(F.col("answer"), web.MEALS, RAW).alias("rows"))
    return told.select("o_custkey", "page", "total", F.inline("rows")).select("o_custkey", F.col("MLSV_YMD").cast("bigint").alias("o_orderkey"), "page", "total", F.col("MMEAL_SC_NM").alias("kind"))


@query("select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' as stamp from events")
def utc_stamp(spark, sf_dir):
    return t(spark, sf_dir, "events").select("event_id", X.utc_stamp(F.col("ts")).alias("stamp"))


@query("""with r as (select l_orderkey, l_partkey, l_suppkey, l_linenumber, case when l_partkey % 11 = 0 then 'x' || strftime(o_orderdate, '%Y%m%d') else strftime(o_orderdate, '%Y%m%d') end a, o_orderdate::date d,
  (case when l_suppkey % 3 = 0 then l_shipdate - interval 60 day when l_suppkey % 3 = 1 then l_shipdate + interval 300 day else l_shipdate end)::date b from lineitem join orders on l_orderkey = o_orderkey)
select l_orderkey, l_partkey, l_suppkey, l_linenumber, case when a[1] = 'x' then 'date' when d > b then 'order' when date_diff('day', d, b) >= 366 then 'length' end as fault from r""")
def range_checks(spark, sf_dir):
    """Date ranges from order to shipping, some spoilt: what is wrong with each."""
    day = lambda c: F.date_format(c, "yyyyMMdd")
    ship, s = F.col("l_shipdate").cast("date"), F.col("l_suppkey") % 3
    end = F.when(s == 0, F.date_sub(ship, 60)).when(s == 1, F.date_add(ship, 300)).otherwise(ship)
    rows = t(spark, sf_dir, "lineitem").join(t(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    start = F.concat(F.when(F.col("l_partkey") % 11 == 0, "x").otherwise(""), day("o_orderdate"))
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", X.range_fault(start, day(end), web.MOST_DAYS).alias("fault"))


@query("""select c_custkey as profile, case when c_custkey % 7 = 0 then 'terms' when c_custkey % 6 not between 1 and 5 then 'spice' when c_custkey % 10 = 9 then 'types' when c_custkey % 25 not between 1 and 19 then 'codes' end as fault from customer
where c_custkey % 7 = 0 or c_custkey % 6 = 0 or c_custkey % 10 = 9 or c_custkey % 25 not between 1 and 19""")
def profile_faults(spark, sf_dir):
    """A profile for each customer, and the first limit that it breaks."""
    k = F.col("c_custkey")
    likes = F.when(k % 7 == 0, F.lit(["a", "b", "c", "d", "e", "f"])).otherwise(F.lit(["a", " a", "b", "c", "d", "e", ""]))
    types = F.when(k % 10 == 9, F.lit(["toy", "none"])).otherwise(F.lit(["toy", "round"]))
    made = t(spark, sf_dir, "customer").select(k.alias("profile"), likes.alias("likes"), F.lit(None).cast("array<string>").alias("avoids"), types.alias("preferred_types"), (k % 6).cast("int").alias("spice_level"), F.array((k % 25).cast("int"), F.lit(7)).alias("allergy_codes"))
    return R.profile_faults(made, RULES)


@query("select e.event_id, e.event_type, o.o_orderkey, o.o_totalprice, e.position from (select *, row_number() over (order by ts desc, event_id) - 1 as position from events) e join (select *, row_number() over (order by o_totalprice, o_orderkey) - 1 as position from orders) o on e.position = o.position")
def positional_zip(spark, sf_dir):
    """Events, latest first, beside orders, cheapest first."""
    events = t(spark, sf_dir, "events").select("event_id", "event_type", (-F.unix_micros(F.col("ts").cast("timestamp"))).alias("age"))
    orders = t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return zipping.zipped(events, ["age", "event_id"], orders, ["o_totalprice", "o_orderkey"]).drop("age")


@query("select event_type as chapter, count_if(event_id % 3 <> 0)::bigint as passed, count_if(event_id % 3 = 0)::bigint as failed, round(sum(value), 1) as total_seconds from events group by 1 union all select 'all', count_if(event_id % 3 <> 0)::bigint, count_if(event_id % 3 = 0)::bigint, round(sum(value), 1) from events")
def report_round_trip(spark, sf_dir):
    """Runs written through the report sink, read again: its rows by chapter, and its own totals."""
    runs = t(spark, sf_dir, "events").select(F.col("event_type").alias("chapter"), F.when(F.col("event_id") % 3 != 0, "PASS").otherwise("FAIL").alias("status"), F.col("value").alias("seconds"))
    path = steps.shared(spark)
    reports.write_report(runs, path)
    rows = reports.report_rows(spark, path, "chapter string, status string, seconds double").groupBy("chapter")
    passed = F.count_if(F.col("status") == "PASS")
    own = rows.agg(passed.alias("passed"), (F.count("*") - passed).alias("failed"), F.round(F.sum("seconds"), 1).alias("total_seconds"))
    return own.unionByName(reports.report_totals(spark, path).select(F.lit("all").alias("chapter"), "passed", "failed", F.round("total_seconds", 1).alias("total_seconds")))


@query(f"with {CLEAN_SQL} select row_id, strftime(date, '%Y-%m-%d') as day, menu_text, calories from clean order by date, row_id limit 5")
def ordered_head(spark, sf_dir):
    rows = clean_meals(spark, sf_dir).select(KEY, F.date_format("date", "yyyy-MM-dd").alias("day"), "menu_text", "calories")
    return report.head(rows, ["day", KEY])


_CARD = ["purpose", "data", "period", "method", "limits", "notice"]


@query(f"with {CLEAN_SQL}, f as (select count(*) n, strftime(min(date), '%Y-%m-%d') a, strftime(max(date), '%Y-%m-%d') b from clean) select 'data' as key, n || ' meals' as value, null as fault from f union all select 'period', a || ' to ' || b, null from f union all select 'method', 'ranking', null union all select 'notice', '{C.SAFETY_NOTICE}', null union all select 'limits', ' ', 'empty' union all select 'purpose', null, 'missing'")
def model_card(spark, sf_dir):
    """A card of the ranking of these meals, one entry forgotten and one left empty, and what the check says."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    facts = clean_meals(spark, sf_dir).agg(F.count("*").alias("n"), day(F.min("date")).alias("a"), day(F.max("date")).alias("b"))
    card = report.model_card(facts, {"data": F.concat("n", F.lit(" meals")), "period": F.concat("a", F.lit(" to "), "b"), "method": F.lit("ranking"), "limits": F.lit(" "), "notice": F.lit(C.SAFETY_NOTICE)})
    return card.join(report.card_faults(card, _CARD), "key", "full")


_PERIOD = f"with {RAW_SQL} select MLSV_YMD, MMEAL_SC_NM, DDISH_NM from raw where SCHUL_NM = 'NATION_16' and MMEAL_SC_NM = '5-LOW' and MLSV_YMD between '19970101' and '19971231'"


def _lunches(spark, sf_dir):
    """What a snapshot is made of: one school's lunches of one year."""
    rows = in_range(raw_meals(spark, sf_dir), "19970101", "19971231").filter("SCHUL_NM = 'NATION_16' and MMEAL_SC_NM = '5-LOW'")
    return rows.withColumn("MMEAL_SC_NM", F.lit(C.LUNCH))


@query(_PERIOD.replace("select MLSV_YMD, MMEAL_SC_NM", f"select MLSV_YMD, '{C.LUNCH}' as MMEAL_SC_NM"))
def snapshot_round_trip(spark, sf_dir):
    path = steps.shared(spark)
    report.write_snapshot(_lunches(spark, sf_dir), path, {"school_name": "NATION_16", "query_start": "19970101", "query_end": "19971231"}, 0)
    return files.snapshot(spark, path, "NATION_16").select("MLSV_YMD", "MMEAL_SC_NM", "DDISH_NM")


@query(f"with {CLEAN_SQL} select strftime(c.date, '%Y-%m-%d') as day, c.menu_text, '{C.FALLBACK_LABEL.format(reason='down')}' as label from clean c where school_name = 'NATION_16' and meal_type = '5-LOW' and date between date '1997-03-01' and date '1997-08-31'")
def live_or_snapshot(spark, sf_dir):
    """The live source fails, so a snapshot's meals of the period come instead, cleaned, and the label says why."""

    def down(*_):
        raise web.SourceError("down")

    path = steps.shared(spark)
    report.write_snapshot(_lunches(spark, sf_dir), path, {"school_name": C.FALLBACK_SCHOOL}, 0)
    rows, label = files.meal_table(spark, C.FALLBACK_SCHOOL, "19970301", "19970831", path, down)
    return rows.select(F.date_format("date", "yyyy-MM-dd").alias("day"), "menu_text", F.lit(label).alias("label"))


@query("select o_custkey, array_to_string(list_sort(list(distinct o_orderpriority)), ',') as kinds, min(strftime(o_orderdate, '%Y-%m-%d')) as low, max(strftime(o_orderdate, '%Y-%m-%d')) as high from orders group by o_custkey")
def distinct_sorted(spark, sf_dir):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("kinds"), F.min(day).alias("low"), F.max(day).alias("high"))


def _twenty() -> dict:
    """Twenty profiles with three allergy sets."""
    words, kinds = ["bolt", "gear", "anvil", "widget", "red", "small", "plate", "gizmo"], ["round", "flat", "heavy", "toy"]
    codes = [(), (3,), (7, 11)]
    return {f"p{i:02}": R.Profile((words[i % 8], f"{words[i % 5]} {words[(i + 3) % 8]}"), (words[(i + 2) % 8],), (kinds[i % 4],), i % 5 + 1, codes[i % 3]) for i in range(20)}


def _twenty_sql() -> str:
    made, shared, out = [], {}, []
    for name, p in _twenty().items():
        made.append(O.ranking("clean", KEY, p, RULES, name, 5, shared))
        out.append(f"select '{name}' as profile, rank::int as rank, {_MENU_SQL} from {name}")
    return f"with {CLEAN_SQL}, {', '.join(made)} " + " union all ".join(out)


@query(_twenty_sql())
def recommend_twenty_profiles(spark, sf_dir):
    """Profiles as a table, ranked in one plan."""
    table = spark.createDataFrame([(n, list(p.likes), list(p.avoids), list(p.preferred_types), p.spice_level, list(p.allergy_codes)) for n, p in _twenty().items()], "profile string, likes array<string>, avoids array<string>, preferred_types array<string>, spice_level int, allergy_codes array<int>")
    return menu(R.batch(clean_meals(spark, sf_dir), KEY, table, 5, RULES), "profile", "rank")


_SETS = [(), (5,), (2, 14), (1, 9, 17)]


@query(f"with {CLEAN_SQL}, " + ", ".join(f"s{i} as materialized (select * from clean where not list_has_any(allergy_codes, {list(c)}::int[])), {O.clusters(f's{i}', KEY, kmeans.FEATURES, 3, f'km{i}')}" for i, c in enumerate(_SETS)) + " " + " union all ".join(f"select {i} as part, k as row_id, cluster_name from km{i}" for i in range(len(_SETS))))
def kmeans_of_sets(spark, sf_dir):
    """Labels of the meals that each of four allergy sets leaves, fitted together."""
    rows = steps.written(clean_meals(spark, sf_dir))
    safe = [~F.arrays_overlap("allergy_codes", F.lit(list(c)).cast("array<int>")) if c else F.lit(True) for c in _SETS]
    fits = kmeans.fitted(rows, KEY, safe)
    each = F.array(*(F.when(s, F.struct(F.lit(i).alias("part"), f.name().alias("cluster_name"))) for i, (s, f) in enumerate(zip(safe, fits, strict=True))))
    return rows.select(KEY, F.inline(F.array_compact(each))).select("part", KEY, "cluster_name")


@query("with s as (select o_orderkey, o_orderpriority, row_number() over (order by o_orderpriority, o_orderkey) - 1 as place, count(*) over () n from orders) select round_even(i * (n - 1) / 7.0, 0)::bigint as place, o_orderpriority, o_orderkey from s join (select range i from range(8)) on place = round_even(i * (n - 1) / 7.0, 0)")
def order_statistics(spark, sf_dir):
    """Orders at eight evenly spaced places of the order by priority (five values) and key."""
    rows = t(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey")
    n = rows.count()
    places = [round(i * (n - 1) / 7) for i in range(8)]
    got = kmeans.at_positions(rows, ["o_orderpriority", "o_orderkey"], places)
    return spark.createDataFrame([(p, r["o_orderpriority"], r["o_orderkey"]) for p, r in zip(places, got, strict=True)], "place long, o_orderpriority string, o_orderkey long")


@query(f"with {CLEAN_SQL}, {O.ranking('clean', KEY, SECOND, RULES, 'a', 3)}, x as (select count_if(list_has_any(allergy_codes, {list(SECOND.allergy_codes)})) n from clean) select replace(replace('{C.SUMMARY.format(shown='#shown', excluded='#excluded', notice=C.SAFETY_NOTICE)}', '#shown', (select count(*) from a)::varchar), '#excluded', n::varchar) as summary from x")
def recommendation_summary(spark, sf_dir):
    """The text beside a result table: how many meals it shows, and how many the allergy codes excluded."""
    summary, shown = report.run_recommendation(clean_meals(spark, sf_dir), KEY, likes_text="widget, ,widget", avoids_text="small rod", preferred_types=["toy"], spice_level=5, allergy_codes=[3], top=3, rules=RULES)
    return shown.agg(F.lit(summary).alias("summary"))


@query(f"with {CLEAN_SQL} select school_name, row_id, rank::int as rank from (select *, row_number() over (partition by school_name order by calories desc, row_id) rank from clean) where rank <= 3")
def top_per_school(spark, sf_dir):
    order = W.partitionBy("school_name").orderBy(F.desc("calories"), KEY)
    return clean_meals(spark, sf_dir).withColumn("rank", F.row_number().over(order)).filter("rank <= 3").select("school_name", KEY, "rank")
