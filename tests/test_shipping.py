"""Queries run from any working directory: the package is shipped to the Python workers."""

import os
import subprocess
import sys
import textwrap

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_queries_run_from_foreign_directory(tmp_path):
    script = textwrap.dedent(f"""
        import importlib.util
        spec = importlib.util.spec_from_file_location("entry_mod", {os.path.join(ROOT, "__spark_entry__.py")!r})
        E = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(E)
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
        n = E.queries()["text_search"](spark, "/root/testdata/sf0.001").count()
        print("ROWS", n)
    """)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", script], cwd=str(tmp_path), env=env, capture_output=True,
                         text=True, timeout=600)
    assert "ROWS" in out.stdout, out.stderr[-2000:]
    assert int(out.stdout.split("ROWS")[1].split()[0]) > 0
