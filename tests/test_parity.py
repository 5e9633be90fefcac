"""Every query with a SQL twin, side by side with DuckDB on the small tables."""

import functools
import math
import os

import pytest

import __spark_entry__ as entry
from meridian.plans import oracles, queries

SF_DIR = "/root/testdata/sf0.001"
LARGER = {"pbo_cscv": "/root/testdata/sf0.01"}  # needs more months than the smallest tables have
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the tables are not here")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return str(v) if hasattr(v, "isoformat") else v


@functools.cache
def duck(folder):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_parity(spark, name):
    folder = LARGER.get(name, SF_DIR)
    df = queries.QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    mine = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=repr)
    rel = duck(folder).sql(oracles.ORACLES[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert mine == sorted(([plain(r[i]) for i in at] for r in rel.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(oracles.ORACLES) <= set(entry.queries())


def test_the_rest_does_without_the_subpackage(tmp_path):
    """A copy without the training-data folders still imports."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/meridian", tmp_path / "meridian", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q and len(q) > 40 and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
