"""The entry module without the training-data folders."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_works_without_the_text_folders(tmp_path, pipeline):
    gone = {os.path.join(ROOT, "effectlab", "llm"), os.path.join(ROOT, "tests", "llm")}
    if not pipeline:
        gone.add(os.path.join(ROOT, "corpus_pipeline.py"))

    def skipped(folder, names):
        return [n for n in names if os.path.join(folder, n) in gone or n in (".git", "__pycache__") or n.startswith(".pytest")]

    copy = shutil.copytree(ROOT, tmp_path / "copy", ignore=skipped)
    code = "import __spark_entry__ as e, effectlab.plans.catalog as c; assert set(e.queries()) == set(c.PLANS); assert e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, check=True, env=os.environ | {"PYTHONPATH": str(copy)})
