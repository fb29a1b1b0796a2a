import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ":".join(x for x in (ROOT, os.environ.get("PYTHONPATH")) if x)  # for Python workers


@pytest.fixture(scope="session")
def spark():
    from annalist.session import session

    folder = tempfile.mkdtemp(prefix="annalist-test-")
    s = session(
        "tests",
        spark_master="local[2]",
        spark_ui_enabled="false",
        spark_sql_shuffle_partitions="3",
        spark_default_parallelism="2",
        spark_driver_memory="3g",
        spark_checkpoint_dir=f"file://{folder}",
        spark_sql_warehouse_dir=f"file://{folder}/warehouse",
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
