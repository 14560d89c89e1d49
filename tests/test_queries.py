"""The driver's queries against their SQL in DuckDB, and the package without the corpus operators."""

import math
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from wirelake import capture_queries, queries

SF = os.environ.get("WIRELAKE_SF", "/root/testdata/sf0.001")
PAIRS = queries.PAIRS | capture_queries.PAIRS
ROOT = Path(__file__).resolve().parents[1]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return [plain(x) for x in v] if isinstance(v, list | tuple) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", PAIRS)
def test_same_rows(spark, duck, name):
    query, sql = PAIRS[name]
    df = query(spark, SF)
    r = duck.execute(sql)
    columns = [d[0] for d in r.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted((repr([plain(row[columns.index(c)]) for c in df.columns]) for row in r.fetchall()))
    assert sorted(repr([plain(x) for x in row]) for row in df.collect()) == want


def test_without_the_corpus_operators(tmp_path):
    """The rest stands alone: nothing but the entry module names the corpus operators."""
    code = "import sys; sys.path.insert(0, sys.argv[1])\nimport importlib.util as u\nreal = u.find_spec\nu.find_spec = lambda n, *a: None if n.startswith(('wirelake.llm', 'corpus_pipeline')) else real(n, *a)\nimport __spark_entry__ as e\nq = e.queries()\nassert q.keys() == e.oracle_sql().keys() and 'agg_streams' in q and not any(k.startswith('op') or k == 'pipeline' for k in q), sorted(q)\nassert not any(m.startswith('wirelake.llm') for m in sys.modules)\n"
    done = subprocess.run([sys.executable, "-c", code, str(ROOT)], capture_output=True, text=True, cwd=tmp_path)
    assert done.returncode == 0, done.stderr
    for p in (ROOT / "wirelake").rglob("*.py"):
        if "llm" not in p.parts:
            assert "wirelake.llm" not in p.read_text(), p
