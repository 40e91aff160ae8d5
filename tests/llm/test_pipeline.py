import os
import shutil
import subprocess
import sys
from pathlib import Path

import corpus_pipeline as P
import pytest
from differential import rows, tables
from helpers import SF, docs, folder
from test_jaccard import brute

from menurank.llm import queries
from menurank.llm.common import table

ROOT = Path(__file__).resolve().parents[2]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, name):
    assert rows(queries.QUERIES[name](spark, SF).toPandas()) == rows(tables(SF).execute(queries.SQL[name]).df())


def test_one_query_for_each_operator():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES if k != "pipeline") == list(range(1, 14))
    assert [n for n, _ in P.STAGES] == ["quality classifier", "n-gram Jaccard join", "PII", "best-fit packing"]


def test_stages(spark):
    whole = table(spark, SF, "documents")
    one = P.quality_stage(spark, whole, SF)
    assert one.columns == whole.columns and 0 < one.count() < whole.count()
    two = P.near_copy_stage(spark, one, SF)
    pairs = [(r["doc_id"], r["text"]) for r in one.collect()]
    assert sorted(r["doc_id"] for r in two.collect()) == sorted(i for i, _, c in brute(pairs, 5, 80) if c == i)
    assert two.columns == whole.columns
    three = P.pii_stage(spark, two, SF)
    assert three.columns == whole.columns and three.count() == two.count()
    assert three.filter("text rlike '\\\\[EMAIL\\\\]'").count() > 0
    last = P.packing_stage(spark, three, SF)
    assert {r["doc_id"] for r in last.collect()} == {r["doc_id"] for r in three.collect()}
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, P.run(spark, SF).collect()))


def test_hard_rows(spark, tmp_path):
    sf = folder(spark, tmp_path)
    frame = docs(spark)
    for _, stage in P.STAGES[:3]:
        frame = stage(spark, frame, sf)
        assert frame.columns == docs(spark).columns
    kept = [r["doc_id"] for r in frame.collect()]
    assert kept.count(1) == 1 and 2 not in kept and kept.count(None) == 2 and {3, 4, 5, 6, 7} <= set(kept)
    assert P.run(spark, folder(spark, tmp_path / "e", [])).count() == 0


def test_different_texts_of_one_id_are_documents_each(spark):
    base = [" ".join(f"w{k}{i}" for i in range(60)) for k in range(4)]
    rows = [(1, base[0]), (1, base[0]), (1, base[1]), (2, base[0] + " more"), (2, base[2]), (3, base[1] + " more"), (4, base[3]), (4, base[3] + " more"), (5, None), (5, ""), (None, base[0]), (None, base[0])]
    frame = docs(spark, rows)
    got = P.near_copy_stage(spark, frame, SF)
    assert got.columns == frame.columns
    want = [(1, base[0]), (1, base[1]), (2, base[2]), (4, base[3]), (5, None), (5, ""), (None, base[0]), (None, base[0])]
    assert sorted((repr((r["doc_id"], r["text"])) for r in got.collect())) == sorted(map(repr, want))


def test_the_rest_of_the_library_does_not_need_this(tmp_path):
    """A copy of the repository without the folders and the pipeline: its queries load, and its own tests are found."""
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "*.log"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and e.llm is None and not any(k.startswith('op1') for k in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env=env)
    found = subprocess.run([sys.executable, "-m", "pytest", "tests", "--collect-only", "-q", "-p", "no:cacheprovider"], cwd=copy, env=env, capture_output=True, text=True)
    assert found.returncode == 0 and "test_queries" in found.stdout
    own = [p for p in (copy / "menurank").rglob("*.py")]
    assert own and not [p for p in own if "llm" in p.read_text()]
