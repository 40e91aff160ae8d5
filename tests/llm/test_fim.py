import hashlib
import re

import pytest
from differential import tables
from helpers import SF, docs, folder, texts

from menurank.llm import fim

MORE = [(20, "a\nb\nc"), (21, "\n\n\n"), (22, "no feed"), (23, "a <P> b\nc"), (24, "x\n<S"), (25, "<M\n>y"), (26, "é😀\n z\r\nq\n"), (27, "<\n" * 50), (28, ">\nS>\nP>\n<"), (-5, "a\nb")]


def plainly(key, text):
    """The contract, by slicing Python strings."""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 100:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 50:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_like_slicing_strings(spark):
    every = texts() + MORE + [(i, "one\ntwo\n\nthree") for i in range(100, 160)]
    out = fim.transformed(docs(spark, every).withColumnRenamed("score", "output"))
    assert "text" not in out.columns and out.columns.count("output") == out.columns.count("n") == 1
    got = [(r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["back"]) for r in out.withColumn("back", fim.restored()).collect()]
    assert sorted(map(repr, got)) == sorted(repr((i, *plainly(i, t or ""), t or "")) for i, t in every)
    assert {g[2] for g in got} == {"plain", "psm", "spm"}


def test_like_the_sql(spark, tmp_path):
    for sf in (SF, folder(spark, tmp_path, texts() + MORE, extra=False)):
        got = sorted(map(repr, map(tuple, fim.op13_fim(spark, sf).collect())))
        assert got and got == sorted(map(repr, tables(sf).execute(fim.ORACLE).fetchall()))


@pytest.mark.parametrize("unit", fim.UNITS)
def test_units_join_to_the_text_and_rates_hold(spark, unit):
    patterns = {"lines": r"[^\n]*\n|[^\n]+", "words": r"^[ \t-\r]+|[^ \t-\r]+[ \t-\r]*", "characters": r"(?s)."}
    every = [(i, t) for i, t in texts() + MORE if t]
    out = fim.transformed(docs(spark, every), unit=unit, rate=50, markers=("⟦p", "⟦s", "⟦m")).withColumn("back", fim.restored(markers=("⟦p", "⟦s", "⟦m"))).collect()
    assert sorted((r["n"], r["back"]) for r in out) == sorted((len(re.findall(patterns[unit], t)), t) for _, t in every)
    h3 = lambda i: int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[16:24], 16) % 100
    assert all((r["form"] == "plain") == (h3(r["doc_id"]) >= 50) for r in out)


def test_empty_table_and_bad_markers(spark):
    assert fim.transformed(docs(spark, [])).count() == 0
    for bad in (("<P>", "<P>", "<M>"), ("aa", "<S>", "<M>"), ("<P>", "x<", "<M>")):
        with pytest.raises(ValueError):
            fim.transformed(docs(spark), markers=bad)
    assert "Exchange" not in fim.op13_fim(spark, SF)._jdf.queryExecution().executedPlan().toString()
