"""Every catalog query that has SQL, against DuckDB on the smallest tables; and the library without its optional part."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from shelfloom import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def rows(frame):
    names = sorted(frame.columns)
    plain = lambda v: tuple(v.tolist() if hasattr(v, "tolist") else v) if hasattr(v, "__len__") and not isinstance(v, str) else None if v != v else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return names, sorted(str(tuple(plain(v) for v in r)) for r in frame[names].astype(object).where(frame[names].notna(), None).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    ours = catalog.queries()[name](spark, SF).toPandas()
    assert rows(ours) == rows(duck.execute(catalog.oracle_sql()[name]).df())


def test_nothing_else_imports_the_optional_part():
    root = Path(catalog.__file__).parent
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "llm" not in f.read_text(), f


def test_entry_imports():
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), set(e.oracle_sql()) <= set(e.queries()))"], cwd=Path(catalog.__file__).parents[1], capture_output=True, text=True, check=True)
    assert out.stdout.split()[1] == "True"
