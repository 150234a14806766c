"""The entry module from another folder, and without the training-text operators."""

import os
import subprocess
import sys

import __spark_entry__ as E

ROOT = os.path.dirname(os.path.abspath(E.__file__))


def run(code, cwd):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    return subprocess.run([sys.executable, "-c", code], cwd=cwd, env=env, capture_output=True, text=True, timeout=300)


def test_every_twin_has_its_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_library_queries_stay_when_the_other_package_breaks(tmp_path):
    code = f"""
import sys
class Broken:
    def find_spec(self, name, path=None, target=None):
        if name.startswith(("wellspring.llm", "corpus_pipeline")):
            raise ImportError("broken " + name)
sys.meta_path.insert(0, Broken())
sys.path.insert(0, {ROOT!r})
import __spark_entry__ as E
names = set(E.queries())
assert "coverage_report" in names and "stream_trend" in names and "pipeline" not in names
assert set(E.oracle_sql()) <= names
"""
    done = run(code, tmp_path)
    assert done.returncode == 0, done.stderr[-2000:]


def test_python_workers_find_the_package_from_another_folder(tmp_path):
    code = f"""
import sys
sys.path.insert(0, {ROOT!r})
import __spark_entry__ as E
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
from wellspring.functions.text import normalize_unicode
rows = spark.createDataFrame([("\\ufb01ne",)], "text string").select(normalize_unicode("text")).collect()
assert rows[0][0] == "fine", rows
"""
    done = run(code, tmp_path)
    assert done.returncode == 0, done.stderr[-2000:]
