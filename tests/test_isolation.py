"""The library without its optional subpackage."""

import os
import shutil
import subprocess
import sys

TOP = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ASK = "import sys, __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), len(o), sorted(set(o) - set(q)), any(k.startswith('op') or k == 'pipeline' for k in q)); assert not [m for m in sys.modules if m.startswith('symreach.llm')]"


def _copy(tmp_path, pipeline):
    left_out = shutil.ignore_patterns("llm", ".git", "__pycache__", *([] if pipeline else ["corpus_pipeline.py"]))
    shutil.copytree(TOP, tmp_path / "copy", ignore=left_out)
    return tmp_path / "copy"


def test_the_entry_without_the_subpackage(tmp_path):
    from symreach.views.queries import ORACLES, QUERIES

    for pipeline in (True, False):
        where = _copy(tmp_path / str(pipeline), pipeline)
        env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
        got = subprocess.run([sys.executable, "-c", ASK], cwd=where, env=env, capture_output=True, text=True, timeout=120)
        assert got.returncode == 0, got.stderr
        assert got.stdout.split(maxsplit=2) == [str(len(QUERIES)), str(len(ORACLES)), "[] False\n"]


def test_nothing_else_imports_the_subpackage():
    for base, _, names in os.walk(os.path.join(TOP, "symreach")):
        if os.path.basename(base) == "llm":
            continue
        for name in names:
            if name.endswith(".py"):
                with open(os.path.join(base, name)) as f:
                    assert ".llm" not in f.read(), name
