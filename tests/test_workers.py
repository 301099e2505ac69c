"""Queries that run Python on executors work from any working folder (the
package is shipped to the workers, not found through the caller's cwd)."""
import os
import subprocess
import sys
import tempfile

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = """
import importlib.util, sys
spec = importlib.util.spec_from_file_location("spark_entry", sys.argv[1])
E = importlib.util.module_from_spec(spec); spec.loader.exec_module(E)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
q = E.queries()
for n in ["d10_diversity_pruning", "f7_contrastive_loss", "c1_embed_column", "e10_retrieval_recall"]:
    q[n](spark, "/root/testdata/sf0.001").count()
print("WORKERS-OK")
"""


def test_python_workers_import_package_from_foreign_cwd():
    cwd = tempfile.mkdtemp(prefix="corpusmill-cwd-")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    r = subprocess.run([sys.executable, "-c", SCRIPT, os.path.join(REPO, "__spark_entry__.py")],
                       cwd=cwd, env=env, capture_output=True, text=True, timeout=600)
    assert "WORKERS-OK" in r.stdout, r.stderr[-3000:]
