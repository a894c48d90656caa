"""The driver contract, with and without the optional subpackage."""

import os
import subprocess
import sys

import __spark_entry__
from helixframe.plans import registry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).limit(1).count() == 1


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_imports_without_the_optional_parts():
    code = (
        "import sys; sys.modules['helixframe.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; "
        "print(len(e.queries()), len(e.oracle_sql()))"
    )
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()
    assert [int(x) for x in out] == [len(registry.QUERIES), len(registry.ORACLES)]
