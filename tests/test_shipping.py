import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession, functions as F
from cuetable.functions.text import extract_json
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
rows = spark.createDataFrame([('x [1] y',)], "v string").select(extract_json(F.col("v")).alias("v")).collect()
assert rows[0].v == "[1]", rows
"""


def test_functions_run_from_a_foreign_folder(tmp_path):
    done = subprocess.run([sys.executable, "-c", SCRIPT, str(ROOT)], cwd=tmp_path, capture_output=True, text=True, timeout=200)
    assert done.returncode == 0, done.stderr[-2000:]
