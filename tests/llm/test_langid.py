import math
import unicodedata
import zlib
from collections import Counter

import pytest
from helpers import SF, docs
from pyspark.sql import functions as F

from menurank.llm import langid

SPEECH = {
    "de": ["der Hund und die Katze sind im Haus", "das Haus ist groß und schön", "wir gehen durch die Straße nach Hause"],
    "en": ["the dog and the cat are in the house", "the house is big and nice", "we walk through the street to the house"],
    "ru": ["собака и кошка дома", "дом большой и красивый"],
}
MORE = [(30, "Straßen Hunde"), (31, "houses streets"), (32, "кошками"), (33, "中文"), (34, "été der"), (35, "123 ... !!"), (36, "٣٤ ½ ² Ⅷ"), (37, "DER HUND"), (38, "and und"), (39, "İstanbul the")]


def speech(spark):
    rows = [(100 + 10 * k + j, t, x) for k, (x, ts) in enumerate(SPEECH.items()) for j, t in enumerate(ts)]
    rows += [(1, "the cat", None), (None, "und die Katze", "de"), (None, "und der Hund", "de"), (100, "der Wal", "de"), (5, None, "en"), (6, "", "en"), (7, "...", "xx")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows


def plain_words(text):
    """Runs of letters, each with the marks after it."""
    out, inside = [], False
    for c in (text or "").lower():
        kind = unicodedata.category(c)[0]
        if kind == "L":
            out = out[:-1] + [out[-1] + c] if inside else [*out, c]
        elif kind == "M" and inside:
            out[-1] += c
        inside = kind == "L" or kind == "M" and inside
    return out


def plain_model(rows, terms):
    kept = {}
    for i, t, x in rows:
        if x and (t is not None or (x, i) not in kept):
            kept[x, i] = min(filter(lambda s: s is not None, (t, kept.get((x, i)))), default=None)
    counts = {}
    for (x, _), t in kept.items():
        for w in plain_words(t):
            counts.setdefault((x, 0), Counter())[w] += 1
            p = f" {w} "
            for z in range(1, 6):
                counts.setdefault((x, z), Counter()).update(g for g in (p[i : i + z] for i in range(len(p) - z + 1)) if g != " ")
    counts = {k: c for k, c in counts.items() if c}
    languages = sorted({x for x, _ in counts})
    each = max(1, terms // (6 * len(languages)))
    most = {z: max(sum(c.values()) for (_, y), c in counts.items() if y == z) for z in range(6)}
    model = {k: {g: math.log(n / sum(c.values())) for g, n in sorted(c.items(), key=lambda e: (-e[1], e[0].encode()))[:each]} for k, c in counts.items()}
    return languages, model, most


def plain_score(text, languages, model, most):
    words, sums = plain_words(text), dict.fromkeys(languages, 0.0)
    if not words:
        return "und", 0.0
    known = lambda g, z: any(g in model.get((x, z), {}) for x in languages)
    for w in words:
        p = f" {w} "
        for z in (0, 5, 4, 3, 2, 1):
            gs = [g for g in ([w] if z == 0 else [p[i : i + z] for i in range(len(p) - z + 1)]) if g != " " and known(g, z)]
            if gs:
                for x in languages:
                    sums[x] += sum(model.get((x, z), {}).get(g, math.log(0.5 / most[z])) for g in gs) / len(gs)
                break
    best = max(languages, key=lambda x: (sums[x], -languages.index(x)))
    return best, 1 / sum(math.exp(s - sums[best]) for s in sums.values())


@pytest.mark.parametrize("terms", [90, 300_000])
def test_like_plain_python(spark, terms):
    rows, known = speech(spark)
    told = plain_model(known, terms)
    model = langid.train(rows, terms=terms)
    assert list(model.languages) == told[0] == ["de", "en", "ru"]
    every = docs(spark).select("doc_id", "text", "score").union(spark.createDataFrame([(i, t, "x") for i, t in MORE], "doc_id long, text string, score string"))
    got = langid.identified(every, model)
    assert got.columns.count("score") == 1
    for r in got.collect():
        lang, score = plain_score(r["text"], *told)
        assert (r["lang_pred"], round(r["score"], 6)) == (lang, round(score, 6)), r["text"]
    by = {r["doc_id"]: r["lang_pred"] for r in got.collect()}
    assert (by[3], by[4], by[5], by[35], by[36]) == ("und",) * 5
    if terms > 1000:
        assert (by[30], by[31], by[32], by[37]) == ("de", "en", "ru", "de") and by[33] == "de"  # nothing known: the first by name


def test_held_out_accuracy(spark):
    sf = SF.replace("0.001", "0.01")
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = langid.op12_langid(spark, sf)
    assert rows.columns == ["doc_id", "held_out", "lang_pred", "score"]
    got = rows.join(truth, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in got)
    held = [r["lang_pred"] == r["lang"] for r in got if r["held_out"]]
    assert len(held) > 200 and sum(held) > 0.98 * len(held)


def test_labels_of_the_held_out_fold_and_other_columns_are_not_seen(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    held = langid.fold(3) == 1
    spoilt = rows.withColumn("lang", F.when(held, "zz").otherwise(F.col("lang"))).withColumn("source", F.lit("z"))
    spoilt.write.parquet(f"{tmp_path}/documents.parquet")
    results = [sorted((r["doc_id"], r["lang_pred"], r["score"]) for r in langid.op12_langid(spark, x).collect()) for x in (SF, str(tmp_path))]
    assert results[0] == results[1]


def test_long_texts_many_words_and_small_memory(spark, monkeypatch):
    rows, known = speech(spark)
    model = langid.train(rows)
    text = " ".join(f"dog{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} der" for i in range(5000))
    monkeypatch.setattr(langid, "KNOWN_WORDS", 50)
    small = langid.Scorer(model)(text)
    monkeypatch.undo()
    whole = langid.Scorer(model)(text)
    assert small[0] == whole[0] == plain_score(text, *plain_model(known, langid.TERMS))[0] and abs(small[1] - whole[1]) < 1e-9


def test_sample_is_bounded_and_nothing_to_learn_from(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("the cat").alias("text"), F.when(F.col("id") % 3 == 0, "en").when(F.col("id") % 3 == 1, "de").alias("lang"))
    assert {(r["lang"], r["count"]) for r in langid.sampled(rows, 40).groupBy("lang").count().collect()} == {("en", 40), ("de", 40)}
    assert langid.sampled(rows, 10**6).count() == 2000
    empty = langid.train(rows.filter("lang is null"))
    assert empty.languages == () and {(r["lang_pred"], r["score"]) for r in langid.identified(rows.limit(5), empty).collect()} == {("und", 0.0)}
    assert langid.train(rows.limit(0)).languages == () and langid.identified(rows.limit(0), empty).count() == 0
