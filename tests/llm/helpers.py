"""Small tables with the cases every operator must stand: nulls, empty and long texts, repeats, clashing columns."""

import json

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def texts():
    long = " ".join(f"w{i % 997} the of" for i in range(9000))
    return [
        (1, "the cat of the house and the big dog of a town"), (2, "The cat of the house and the big dog of a town"), (3, None), (4, ""), (5, " \t\n\x0b\x0c\r "), (6, "one two"),
        (7, long), (8, long + " extra words at the end"), (9, "é\u3000ü ß ẞ \x1c x\u00a0y 😀"), (10, "x" * 30000), (11, "1 " * 4000), (1, "the cat of the house and the big dog of a town"), (None, "no id for this text"),
        (None, None), (12, "mail a.b@c.de or +49 30 1234567 now"), (13, "mail a.b@c.de or +49 30 1234567 now"),
    ]


def docs(spark, rows=None, extra=True):
    out = spark.createDataFrame([(i, t, None, "s1" if i else None, None if t is None else len(t)) for i, t in (texts() if rows is None else rows)], SCHEMA)
    if extra:
        for c in ("score", "predicted", "shard", "slot", "n", "part", "guest", "train", "n_tokens", "ids", "block", "length", "cluster", "spans", "base", "k1", "a", "b", "text2"):
            out = out.withColumn(c, F.lit("clash"))
    return out


def folder(spark, path, rows=None, labels=(), extra=True):
    docs(spark, rows, extra).write.mode("overwrite").parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{path}/labels.parquet")
    return str(path)


def same(a, b):
    return json.dumps(sorted(map(repr, a))) == json.dumps(sorted(map(repr, b)))
