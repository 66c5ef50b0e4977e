import importlib.util
import pathlib
import subprocess
import sys

ROOT = pathlib.Path(__file__).resolve().parents[1]


def test_entry_imports_without_the_subpackage(tmp_path):
    """The rest works when the llm folders and the pipeline are gone."""
    import shutil

    shutil.copytree(ROOT / "helixframe", tmp_path / "helixframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copytree(ROOT / "jobs", tmp_path / "jobs", ignore=shutil.ignore_patterns("__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), set(e.oracle_sql()) <= set(e.queries()))"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert said.stdout.split()[1:] == ["True"] and int(said.stdout.split()[0]) > 20, said.stderr


def test_names_agree():
    spec = importlib.util.spec_from_file_location("entry_under_test", ROOT / "__spark_entry__.py")
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_workers_import_the_package_from_any_folder(tmp_path):
    """A query with a Python UDF runs where the driver was started outside the repository and has no PYTHONPATH."""
    import os

    code = f"""
import sys; sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession, functions as F
from helixframe.operators.align import similarity_ratio
from helixframe.shipping import ship
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
rows = ship(spark).createDataFrame([("ACGT", "AGT")], "a string, b string").select(similarity_ratio("a", "b").alias("e"))
print("ratio", round(7 * rows.first()["e"]))
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "ratio 6" in said.stdout, said.stderr[-2000:]
