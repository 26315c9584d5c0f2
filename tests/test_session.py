"""The shared folder of sessions with and without the setting."""

import os
import subprocess
import sys
from pathlib import Path

PLAIN = """
from claimweave import session
spark = session.local_session(1, "1g", 1)
assert spark.conf.get("spark.checkpoint.dir", None) is None
first = session.shared_dir(spark)
assert session.shared_dir(spark) == first and spark.sparkContext.getCheckpointDir()
assert session.materialize(spark.range(3), "x").count() == 3 and session.clean(spark) == 1
"""


def test_local_session_without_a_setting(tmp_path):
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": str(Path(__file__).resolve().parents[1]), "TMPDIR": str(tmp_path)}
    done = subprocess.run([sys.executable, "-c", PLAIN], env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
