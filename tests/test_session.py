"""The package runs away from its own folder, and never in a folder executors cannot share."""

import os
import subprocess
import sys
import types

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_shared_folder_needs_a_name_on_a_cluster():
    from askloom.session import shared_folder

    conf = types.SimpleNamespace(get=lambda *a: None)
    context = types.SimpleNamespace(getConf=lambda: conf, master="spark://host:7077")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(types.SimpleNamespace(conf=conf, sparkContext=context))


def test_query_runs_from_another_folder(tmp_path):
    """Workers get the package although neither their folder nor PYTHONPATH has it."""
    code = (
        f"import sys; sys.path.insert(0, {ROOT!r})\n"
        "from askloom.session import get_spark\n"
        "spark = get_spark('elsewhere', 'local[2]', **{'spark.ui.enabled': 'false', 'spark.sql.shuffle.partitions': '2'})\n"
        "from __spark_entry__ import queries\n"
        "print('ROWS', queries()['hashed_text_embedding'](spark, '/root/testdata/sf0.001').count())\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "ROWS 200" in done.stdout, done.stderr[-2000:]
