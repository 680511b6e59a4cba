"""Every core query that has SQL gives the rows of its SQL; the others run and keep their schema."""

import os

import pytest

from conftest import DATA, rows_of, rows_of_sql
from yearloom.plans import catalogue

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_matches_sql(spark, duck, name):
    names, rows = rows_of(catalogue.queries()[name](spark, DATA))
    if name in catalogue.oracle_sql():
        assert (names, rows) == rows_of_sql(duck, catalogue.oracle_sql()[name])


def test_entry_imports_without_the_llm_part():
    import subprocess
    import sys

    code = "import sys; sys.modules['yearloom.llm'] = None; import __spark_entry__ as e; assert e.llm is None and 'panel_z_curve' in e.queries()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
