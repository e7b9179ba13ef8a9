"""The library without the training-data subpackage: everything else is imported and listed."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
ASK = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"


def test_queries_without_the_subpackage(tmp_path):
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path)
    shutil.copytree(ROOT / "lodeweave", tmp_path / "lodeweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "lodeweave" / "llm" / "__pycache__").mkdir(parents=True)  # what deleting the sources may leave
    for _ in range(2):
        out = subprocess.run([sys.executable, "-c", ASK], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True)
        assert out.returncode == 0, out.stderr
        n, n_sql, pipeline = out.stdout.split()
        assert int(n) > 150 and int(n_sql) > 150 and pipeline == "False"
        (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
