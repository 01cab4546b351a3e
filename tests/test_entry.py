import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as driver
from notequarry import catalog

ROOT = Path(__file__).resolve().parent.parent
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_registry():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES) and len(catalog.QUERIES) > 40
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_everything_else_imports_without_the_operators(tmp_path):
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("notequarry.llm"):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert e.queries() and not any(n.startswith("op") or n == "pipeline" for n in e.queries())
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


@pytest.mark.skipif(not Path(DATA).exists(), reason="no driver tables")
def test_entry(spark):
    assert driver.entry(spark).count() > 0


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.skipif(not Path(DATA).exists(), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_against_sql(spark, name):
    with duckdb.connect() as db:
        for t in TABLES:
            db.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
        cursor = db.execute(catalog.ORACLES[name])
        columns, expected = [c[0] for c in cursor.description], cursor.fetchall()
    df = driver.queries()[name](spark, DATA)
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    assert got == sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in expected), key=repr)
