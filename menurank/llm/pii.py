"""Personal data: base patterns, and terms that disclose protected entities by corpus co-occurrence.

An entity is a matched value, or a class of values that is the same for many: the domains an address is in, a network, an
issuer or industry of cards, the area or zone of a phone number. A value is rarely in several texts, a class is. A term
(a run of letters outside the matches) discloses an entity if the pointwise mutual information of term and entity over the
corpus reaches THETA times the entity's own information: log2(N * n_te / (n_t * n_e)) >= THETA * log2(N / n_e), all counts
in distinct texts, n_te at least SUPPORT. Wherever such a term is in any text, it is a span of kind `term`, which
sanitised() generalises, as it replaces the base spans.

Everything is DataFrame functions. One pass over texts matches the base patterns and stores the spans, entities and words of each
text; all counts are made from these. Texts are read again for the places of terms only, and matched only if they hold one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cached, drop, forget, stored, table

KINDS = ("email", "ip", "card", "phone", "term")
SUPPORT, THETA = 3, 0.8
LETTERS = r"\p{L}{2,}+"
BROADCAST_TERMS, BROADCAST_BYTES = 500_000, 32 << 20  # only plans depend on these, not results

# The contract's patterns, in forms that find the same matches but neither recurse nor try a run of characters twice:
# a match begins where a run begins or where the last match ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # Runs are maximal; only those of 14 to 19 digits can be cards.
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without a match of this has none of the pattern; it is quick to test.
MAY = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}


def located(text: Column, pattern: str) -> Column:
    """Places and texts (s, e, m) of leftmost non-overlapping matches of pattern, in code points. The text is split once
    at the matches; lengths before a match, summed up, give its place."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(found.alias("m"), F.slice(F.split(text, pattern, -1), 1, F.size(found)).alias("gap"))

    def step(acc, x):
        s = acc["at"] + F.length(x["gap"])
        e = s + F.length(x["m"])
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m")))).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int,m:string>>").alias("out"))
    return F.when(F.size(found) > 0, F.aggregate(pairs, start, step, lambda acc: acc["out"])).otherwise(F.array().cast("array<struct<s:int,e:int,m:string>>"))


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    each = F.transform(F.split(F.reverse(number), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, 2 * c.cast("int") - 9).otherwise(2 * c.cast("int"))))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def passes(kind: str, m: Column) -> Column:
    if kind == "ip":
        bare = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(m, "[.]"), lambda p: (F.length(bare(p)) <= 3) & (F.coalesce(bare(p).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.length(digits(m)).between(14, 19) & luhn(digits(m))
    if kind == "phone":
        return F.length(digits(m)).between(10, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """array<struct<s, k, e>>, by start and kind (k is a place in KINDS)."""

    def of(k: int, kind: str) -> Column:
        may = F.contains(text, F.lit("@")) if kind == "email" else text.rlike(MAY[kind])
        none = F.array().cast("array<struct<s:int,e:int,m:string>>")
        good = F.filter(F.when(may, located(text, PATTERNS[kind])).otherwise(none), lambda p: passes(kind, p["m"]))
        return F.transform(good, lambda p: F.struct(p["s"].alias("s"), F.lit(k).alias("k"), p["e"].alias("e")))

    every = [of(k, kind) for k, kind in enumerate(KINDS[:4])]
    return F.array_sort(F.concat(*every))


def entities(text: Column, span) -> Column:
    """array<string>: the value of a span and the classes it is in."""
    value, k = F.lower(F.substring(text, span["s"] + 1, span["e"] - span["s"])), span["k"]
    labels, number = F.split(F.substring_index(value, "@", -1), "[.]"), digits(value)
    domains = [F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".") for n in (2, 3, 4)]
    of = {
        "email": [value, F.substring_index(value, "@", -1), *domains],
        "ip": [value, *(F.concat(F.substring_index(value, ".", n), F.lit(".")) for n in (1, 2, 3))],
        "card": [number, F.substring(number, 1, 6), F.substring(number, 1, 1)],
        "phone": [number, F.substring(number, 1, 4), F.substring(number, 1, 1)],
    }
    listed_ = F.coalesce(*(F.when(k == i, F.array(*of[kind])) for i, kind in enumerate(KINDS[:4])))
    return F.transform(F.array_distinct(listed_), lambda x: F.concat(k.cast("string"), F.lit(":"), x))


def masked(text: Column, spans: Column) -> Column:
    """text with blanks in place of the spans' characters, as long as before."""

    def step(acc, p):
        at = F.greatest(acc["at"], p["s"])
        new = F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, at - acc["at"]), F.repeat(F.lit(" "), F.greatest(p["e"] - at, F.lit(0)))))
        return F.struct(F.greatest(at, p["e"]).alias("at"), new.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    whole = F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def found_words(text: Column) -> Column:
    """array<string>: the distinct runs of letters of a text, lower-cased."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(LETTERS), F.lit(0)), F.lower))


def places(text: Column, terms: Column) -> Column:
    """array<struct<s, k, e>>: where any of terms is a whole run of letters in text; one pass over the text's runs."""
    runs = F.arrays_zip(F.regexp_extract_all(text, F.lit(LETTERS), F.lit(0)).alias("run"), F.slice(F.split(text, LETTERS, -1), 1, F.size(F.regexp_extract_all(text, F.lit(LETTERS), F.lit(0)))).alias("gap"))

    def step(acc, x):
        s = acc["at"] + F.length(x["gap"])
        e = s + F.length(x["run"])
        own = F.array(F.struct(s.alias("s"), F.lit(4).alias("k"), e.alias("e")))
        return F.struct(e.alias("at"), F.when(F.array_contains(terms, F.lower(x["run"])), F.concat(acc["out"], own)).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,k:int,e:int>>").alias("out"))
    return F.aggregate(runs, start, step, lambda acc: acc["out"])


def disclosing(found: DataFrame) -> DataFrame:
    """(term, entity) pairs over the threshold. found: h (a text's hash), entities (none without base spans) and words of each text.

    A term is with an entity in no more texts than it or the entity is in: what that bound rules out isn't paired. Of
    equal texts each counts as one part of their number, so they count as one text though no text is moved."""
    copies = found.groupBy("h").agg(F.count("*").alias("c"))
    total = float(max(1, copies.count()))
    repeated = cached(copies.filter("c > 1"))
    most_texts = lambda n_e: total ** (1 - THETA) * F.pow(n_e, F.lit(THETA)) * (1 + 1e-9)
    seen = stored(found.filter(F.size("entities") > 0).groupBy("h").agg(F.min("entities").alias("entities"), F.min("words").alias("words")))
    held = seen.select("h", F.explode("entities").alias("entity"))
    held = stored(held.join(held.groupBy("entity").agg(F.count("*").alias("n_e")).filter(F.col("n_e") >= SUPPORT), "entity"))
    bound = held.agg(most_texts(F.max("n_e")).alias("b")).first()["b"] or 0.0
    near = seen.select("h", F.explode("words").alias("term"))
    enough = lambda n_t: F.log2(total * F.col("n_te") / (n_t * F.col("n_e"))) >= THETA * F.log2(total / F.col("n_e"))
    # A term is in as many texts as it is in with entities, at least: this rules most out before all texts are counted.
    terms = stored(near.groupBy("term").agg(F.count("*").alias("n_near")).filter(F.col("n_near").between(SUPPORT, bound)))
    own = held.groupBy("h").agg(F.collect_list(F.struct("entity", "n_e")).alias("own"))  # a text's entities
    near = seen.join(own, "h").select("own", F.explode("words").alias("term")).join(few(terms), "term")
    pairs = near.select("term", "n_near", F.explode("own").alias("one")).select("term", "n_near", "one.entity", "one.n_e").filter(F.col("n_near") <= most_texts(F.col("n_e")))
    joint = pairs.groupBy("term", "entity", "n_near", "n_e").agg(F.count("*").alias("n_te")).filter(F.col("n_te") >= SUPPORT)
    joint = stored(joint.filter(enough(F.col("n_near"))))
    wanted = cached(joint.select("term").distinct())
    weighed = found.select("h", "words").join(few(repeated), "h", "left").select((1.0 / F.coalesce("c", F.lit(1))).alias("part"), F.explode("words").alias("term"))
    counts = among(weighed, wanted).groupBy("term").agg(F.round(F.sum("part")).alias("n_t"))
    out = stored(joint.join(counts, "term").filter(enough(F.col("n_t"))).select("term", "entity"))
    drop(repeated, wanted)
    forget(seen, held, terms, joint)
    return out


def is_small(rows: DataFrame) -> bool:
    """Whether narrow rows (numbers, hashes, a term) are at most BROADCAST_TERMS, and their terms BROADCAST_BYTES."""
    size = F.sum(F.octet_length("term")) if "term" in rows.columns else F.lit(0)
    told = rows.agg(F.count("*").alias("n"), size.alias("b")).first()
    return told["n"] <= BROADCAST_TERMS and (told["b"] or 0) <= BROADCAST_BYTES


def few(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if is_small(rows) else rows


def among(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """Rows whose term is one of terms, if these are few; else all rows, as counting them first moves less."""
    return rows.join(F.broadcast(terms), "term", "left_semi") if is_small(terms) else rows


def all_spans(docs: DataFrame) -> DataFrame:
    """doc_id, k1, k2 (hashes of the row's id and text), base and spans (arrays of s, k, e) for each row of docs.

    Null texts count as empty and have no spans. Rows equal in id and text have equal spans. Base spans of different
    kinds may overlap. Very long texts are read whole. An empty table gives no rows; other columns are ignored.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keys = rows.withColumn("k1", F.xxhash64("doc_id", "text")).withColumn("k2", F.xxhash64(F.lit(7), "text", "doc_id")).withColumn("h", F.xxhash64("text"))
    based = keys.withColumn("base", base_spans(F.col("text")))
    none = F.array().cast("array<string>")
    listed_ = F.when(F.size("base") > 0, F.array_distinct(F.flatten(F.transform("base", lambda span: entities(F.col("text"), span))))).otherwise(none)
    words = found_words(masked(F.col("text"), F.col("base")))
    found = stored(based.select("doc_id", "k1", "k2", "h", "base", listed_.alias("entities"), words.alias("words")))
    terms = cached(disclosing(found).select("term").distinct())
    out = found.select("doc_id", "k1", "k2", "base")
    if terms.isEmpty():
        drop(terms)
        return out.withColumn("spans", F.col("base"))
    told = found.select("k1", "k2", F.explode("words").alias("term")).join(few(terms), "term", "left_semi")
    told = stored(told.groupBy("k1", "k2").agg(F.collect_set("term").alias("terms")))
    drop(terms)
    held, based = keys.select("k1", "k2", "text"), out.select("k1", "k2", "base")
    if is_small(told.select("k1")):  # their keys take 16 bytes each; then only texts that hold terms are moved
        held, based = (x.join(F.broadcast(told.select("k1", "k2")), ["k1", "k2"], "left_semi") for x in (held, based))
    both = held.join(told.hint("merge"), ["k1", "k2"]).join(based.dropDuplicates(["k1", "k2"]), ["k1", "k2"])
    more = both.dropDuplicates(["k1", "k2"]).select("k1", "k2", places(masked(F.col("text"), F.col("base")), F.col("terms")).alias("more"))
    nowhere = F.array().cast("array<struct<s:int,k:int,e:int>>")
    return out.join(more, ["k1", "k2"], "left").select("doc_id", "k1", "k2", "base", F.array_sort(F.concat("base", F.coalesce("more", nowhere))).alias("spans"))


def listed(spans) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda p: F.concat_ws(":", F.get(names, p["k"]), p["s"], p["e"])), ",")


def replaced(text: Column, spans: Column) -> Column:
    """text with each span's characters replaced by its kind in brackets; overlapping spans go as one, by the first."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def step(acc, p):
        new = F.struct(p["e"].alias("at"), F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, p["s"] - acc["at"]), F.get(names, p["k"]))).alias("out"))
        return F.when(p["s"] >= acc["at"], new).otherwise(F.struct(F.greatest(acc["at"], p["e"]).alias("at"), acc["out"].alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    rest = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, rest)).otherwise(text)


def sanitised(docs: DataFrame) -> DataFrame:
    """docs with every span in its texts replaced; columns, rows and null texts stay. n_chars follows the text."""
    key = lambda text: (F.xxhash64("doc_id", text).alias("k1"), F.xxhash64(F.lit(7), text, "doc_id").alias("k2"))
    spans = all_spans(docs).filter(F.size("spans") > 0).select("k1", "k2", "spans").dropDuplicates(["k1", "k2"])
    keyed = docs.select(F.struct(*docs.columns).alias("row"), *key(F.coalesce("text", F.lit(""))))
    joined = keyed.join(spans, ["k1", "k2"], "left").select(F.when(F.col("spans").isNotNull(), replaced(F.col("row.text"), F.col("spans"))).otherwise(F.col("row.text")).alias("new"), "row")
    new = {"text": F.col("new")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("new").cast(docs.schema["n_chars"].dataType)
    return joined.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def op9_pii(spark, sf_dir):
    spans = all_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda p: p["k"] == k)).cast("long")
    return spans.select("doc_id", *(count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS[:4])), F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


QUERIES = {"op9_pii": op9_pii}
SQL: dict[str, str] = {}
