"""The entry points without the folders that may be absent."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).parent.parent

SCRIPT = """
import __spark_entry__ as entry
print(len(entry.queries()), len(entry.oracle_sql()), "pipeline" in entry.queries())
"""


@pytest.mark.parametrize("gone", [["sessionlake/llm"], ["sessionlake/llm", "corpus_pipeline.py"]])
def test_without_the_optional_modules(tmp_path, gone):
    for name in ("sessionlake", "__spark_entry__.py", "corpus_pipeline.py"):
        if (REPO / name).is_dir():
            shutil.copytree(REPO / name, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__", *(g.split("/")[-1] for g in gone)))
        elif name not in gone and (REPO / name).exists():
            shutil.copy(REPO / name, tmp_path / name)
    assert not any((tmp_path / g).exists() for g in gone)
    # Nothing of this repository but the copy may be found.
    ran = subprocess.run([sys.executable, "-I", "-c", f"import sys; sys.path.insert(0, {str(tmp_path)!r})\n{SCRIPT}"],
                         capture_output=True, text=True, cwd=tmp_path)
    assert ran.returncode == 0, ran.stderr
    queries, oracles, pipeline = ran.stdout.split()
    assert int(queries) == int(oracles) >= 43 and pipeline == "False"
