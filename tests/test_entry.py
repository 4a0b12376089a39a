import subprocess
import sys
from pathlib import Path

import __spark_entry__


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).limit(1).count() == 1


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_queries_are_listed_without_a_session():
    told = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()) >= len(e.oracle_sql()) > 100)"], capture_output=True, text=True, check=True, cwd=Path(__file__).parent.parent)
    assert told.stdout.strip() == "True"
