"""The entry point from a folder in which the workers do not find the package."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master({master!r}).config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", {shared!r}).getOrCreate()
import __spark_entry__ as e
known = e.queries()
for name in ("met_08_duplication_file", "win_03_rolling_quantiles", "fn_13_hold_out", "str_03_rolling_stream", "op12_filter_audit"):
    if name in known:
        print("ROWS", name, known[name](spark, "/root/testdata/sf0.001").count())
"""


@pytest.mark.parametrize("master", ["local[2]", "local-cluster[1,2,1024]"])
def test_queries_run_where_workers_lack_the_package(tmp_path, master):
    if not Path("/root/testdata/sf0.001").is_dir():
        pytest.skip("no tables")
    elsewhere = tmp_path / "elsewhere"
    elsewhere.mkdir()
    paths = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and Path(p).resolve() != ROOT]
    env = {**os.environ, "PYTHONPATH": os.pathsep.join(paths), "PYSPARK_PYTHON": sys.executable, "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_SCALA_VERSION": "2.13"}
    home = tmp_path / "home"
    home.mkdir()
    import pyspark

    for p in Path(pyspark.__file__).parent.iterdir():  # a local cluster writes its logs beside Spark
        if p.name != "work":
            (home / p.name).symlink_to(p)
    script = SCRIPT.format(root=str(ROOT), master=master, shared=str(tmp_path / "shared"))
    out = subprocess.run([sys.executable, "-c", script], cwd=elsewhere, env={**env, "SPARK_HOME": str(home)}, capture_output=True, text=True, timeout=240)
    rows = [line.split() for line in out.stdout.splitlines() if line.startswith("ROWS")]
    assert out.returncode == 0 and len(rows) >= 4 and all(int(n) > 0 for *_, n in rows), out.stderr[-3000:]
