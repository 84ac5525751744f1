"""Every registered query of the catalogue against its SQL, and that all works without the llm folder."""

import os
import subprocess
import sys

import duckdb
import pytest

from redraft.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES.split():
        c.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_as_sql(spark, db, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    r = db.sql(catalogue.ORACLE_SQL[name])
    assert sorted(r.columns) == columns
    place = [r.columns.index(c) for c in columns]
    want = sorted(repr(tuple(x[i] for i in place)) for x in r.fetchall())
    assert sorted(repr(tuple(x[c] for c in columns)) for x in df.collect()) == want


def test_closure_of_the_whole_table(spark, db):
    """Against a search by breadth over all line items."""
    after = {}
    for part, supplier in db.sql("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem").fetchall():
        after.setdefault(f"p{part}", set()).add(f"s{supplier}")
        after.setdefault(f"s{supplier}", set()).add(f"p{part + 1}")
    want, now = {}, {"p1"}
    while now:
        now = {y for x in now for y in after.get(x, ())} - want.keys() - {"p1"}
        want |= dict.fromkeys(now, max(want.values(), default=0) + 1)
    got = {r["node"]: r["depth"] for r in catalogue.QUERIES["closure_whole"](spark, SF).collect()}
    assert got == want and len(got) > 150


def test_works_without_the_llm_folder(tmp_path):
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    (tmp_path / "redraft").mkdir()
    for name in os.listdir(f"{here}/redraft"):
        if name != "llm":
            os.symlink(f"{here}/redraft/{name}", tmp_path / "redraft" / name)
    os.symlink(f"{here}/__spark_entry__.py", tmp_path / "__spark_entry__.py")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'rename_run' in q and not any(n.startswith('op') for n in q) and set(e.oracle_sql()) <= set(q)"
    code += f"; from pyspark.sql import SparkSession; s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate(); assert q['rename_many'](s, '{SF}').count() > 1000"  # one that starts Python workers
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)
