import os
import shutil
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from meridia.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_query_with_sql_is_registered():
    assert set(SQL) <= set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["simple_returns", "summary_metrics", "drawdown_episodes", "ewma_volatility", "rebalanced_wealth", "shrunk_covariance", "overfitting_probability"])
def test_same_as_sql(spark, db, name):
    got, want = QUERIES[name](spark, SF).toPandas(), db.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    keys = [c for c in got.columns if got[c].dtype.kind != "f"] + [c for c in got.columns if got[c].dtype.kind == "f"]
    frames = []
    for frame in (got, want):
        frame = frame[keys].copy()
        for c in (c for c in keys if "date" in c):
            frame[c] = pd.to_datetime(frame[c]).astype("datetime64[us]")  # either engine's unit
        frames.append(frame.sort_values(keys, ignore_index=True))
    pd.testing.assert_frame_equal(*frames, check_dtype=False, atol=2e-6)


def test_entry_without_the_training_data_operators(tmp_path):
    """With both folders gone the rest is registered, though corpus_pipeline.py is still there."""
    for name in ("meridia", "__spark_entry__.py", "bench.py", "corpus_pipeline.py"):
        if os.path.isdir(path := os.path.join(ROOT, name)):
            shutil.copytree(path, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif os.path.exists(path):
            shutil.copy(path, tmp_path / name)
    code = "import __spark_entry__ as e, bench; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(sorted(x for x in q if x.startswith('op') and x[2].isdigit() or x == 'pipeline'), 'summary_metrics' in q)"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    assert out.stdout.strip() == "[] True"


@pytest.mark.parametrize("module", ["xxhash", "tokenizers", "public_tokenizers"])
def test_entry_where_a_library_of_those_operators_is_missing(module):
    code = f"import sys; sys.modules[{module!r}] = None; import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print([x for x in q if x.startswith('op1') or x == 'pipeline'], 'summary_metrics' in q)"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, env=os.environ | {"PYTHONPATH": ROOT}, capture_output=True, text=True, check=True)
    assert out.stdout.strip() == "[] True"


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
