import shutil
import subprocess
import sys

import pytest
from conftest import DATA, ROOT

from sparkloom.plans.registry import QUERIES, SQL


@pytest.mark.parametrize("name", list(SQL))
def test_query_equals_sql(spark, same_as_sql, name):
    same_as_sql(QUERIES[name](spark, DATA), SQL[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_entry_without_the_training_data_part(tmp_path):
    """With those folders deleted all else imports, and its queries are there."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=lambda folder, names: [n for n in names if n in ("llm", ".git", "corpus_pipeline.py", "__pycache__")])
    (copy / "sparkloom" / "llm").mkdir()  # an empty folder is no package
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(k.startswith('op') for k in q), 'pipeline' in q, set(e.oracle_sql()) <= set(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert done.stdout.split() == [str(len(QUERIES)), "False", "False", "True"]
