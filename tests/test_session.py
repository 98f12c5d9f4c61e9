"""Where tables between steps go; in a process of its own, whose session has no preset folder."""

from __future__ import annotations

import os
import subprocess
import sys

SCRIPT = """
import os, tempfile
from tableferry import build_session, scratch, work_dir
from tableferry.operators.ordering import with_position

spark = build_session("bare", "local[1]", **{"spark.sql.shuffle.partitions": "1"})
assert spark.conf.get("spark.checkpoint.dir", None) is None
a, b = work_dir(spark, "x"), work_dir(spark, "x")
assert a != b and os.path.dirname(a) == os.path.dirname(b)
with scratch(spark) as owner:
    rows = with_position(spark.range(10), ["id"]).count()
    assert rows == 10 and os.listdir(owner)
assert not os.path.exists(owner)
assert os.path.dirname(work_dir(spark, "y")) == os.path.dirname(a)
print("done")
"""


def test_a_session_without_a_preset_folder(tmp_path):
    (tmp_path / "conf").mkdir()
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {**os.environ, "SPARK_CONF_DIR": str(tmp_path / "conf"), "PYTHONPATH": root, "TMPDIR": str(tmp_path)}
    done = subprocess.run([sys.executable, "-c", SCRIPT], env=env, capture_output=True, text=True, timeout=300)
    assert done.stdout.strip().endswith("done"), done.stderr[-2000:]
