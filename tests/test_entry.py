"""The registry can be read without a session, and its queries have unique, stable columns."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__


def test_registry_needs_no_session():
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and len(q) > 60"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[1], check=True)


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns[:2] == ["entity", "n"] and df.count() == 15


def test_plain_queries_have_unique_columns(spark, sf):
    for name, f in __spark_entry__.queries().items():
        if not name.startswith("op") and name not in ("pipeline", "det_components"):
            cols = [c.lower() for c in f(spark, sf).columns]
            assert len(set(cols)) == len(cols), name
