"""Every registered query against its SQL, and rows for those without one."""

import pytest
from compare import differences, sql_frame

import __spark_entry__ as entry_point

QUERIES, SQL = entry_point.queries(), entry_point.oracle_sql()


@pytest.mark.parametrize("name", sorted(q for q in QUERIES if q.startswith("q_")))
def test_matches_sql(spark, small, name):
    got = QUERIES[name](spark, small).toPandas()
    assert len(got) > 0
    if name in SQL:
        assert differences(got, sql_frame(small, SQL[name])) == []


def test_entry(spark):
    assert entry_point.entry(spark).count() == 10


def test_sql_only_for_registered_queries():
    assert set(SQL) <= set(QUERIES)


def test_entry_without_the_corpus_operators():
    import os
    import subprocess
    import sys
    code = ("import sys; sys.modules['voxloom.llm'] = None\n"
            "import __spark_entry__ as e; q = e.queries(); assert 'q_dice' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0
