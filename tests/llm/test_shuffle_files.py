"""What was shuffled for a written table goes from disk at once."""

import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys, time
from pathlib import Path
from pyspark.sql import SparkSession
at = Path(sys.argv[1])
spark = (SparkSession.builder.master("local[2]").config("spark.local.dir", str(at / "local")).config("spark.checkpoint.dir", str(at / "shared"))
    .config("spark.driver.host", "127.0.0.1").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate())
from florilege.llm.common import CLEAN_SHUFFLES, stored
held = stored(spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count())
for _ in range(50):
    left = list((at / "local").rglob("shuffle_*"))
    if not left:
        break
    time.sleep(0.2)
assert not left, left
assert held.count() == 7 and spark.conf.get(CLEAN_SHUFFLES) == "false"
"""


def test_no_shuffle_is_left(tmp_path):
    root = Path(__file__).resolve().parents[2]
    done = subprocess.run([sys.executable, "-c", SCRIPT, str(tmp_path)], cwd=root, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
