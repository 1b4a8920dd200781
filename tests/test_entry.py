"""The entry module without the optional subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _copy(to, without):
    for name in ("farewise", "__spark_entry__.py", "corpus_pipeline.py"):
        source = os.path.join(ROOT, name)
        if name in without or not os.path.exists(source):
            continue
        if os.path.isdir(source):
            shutil.copytree(source, f"{to}/{name}", ignore=shutil.ignore_patterns("__pycache__", *(os.path.basename(w) for w in without)))
        else:
            shutil.copy(source, to)


def test_entry_without_the_optional_subpackage(tmp_path):
    code = "import __spark_entry__ as e; q = e.queries(); o = e.oracle_sql(); print(len(q), set(q) == set(o), any(n.startswith('op') or n == 'pipeline' for n in q))"
    for i, without in enumerate((["farewise/llm"], ["farewise/llm", "corpus_pipeline.py"])):
        to = tmp_path / str(i)
        to.mkdir()
        _copy(to, without)
        env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
        done = subprocess.run([sys.executable, "-c", code], cwd=to, env=env, capture_output=True, text=True, timeout=120)
        assert done.returncode == 0, done.stderr
        count, same, optional = done.stdout.split()
        assert int(count) > 40 and same == "True" and optional == "False"
