import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "2").getOrCreate())
spark.sparkContext.setLogLevel("ERROR")
from pulseframe.operators.models import IsolationForest
df = spark.range(300).selectExpr("id", "cast(id % 17 AS double) AS a", "cast(id % 5 AS double) AS b")
out = IsolationForest(["a", "b"], "id", trees=5).fit(df).transform(df)
print("ROWS", out.count())
"""


def test_python_workers_import_package_from_other_cwd(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    r = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True,
                       text=True, timeout=600)
    assert "ROWS 300" in r.stdout, r.stderr[-2000:]
