"""The registered queries, with and without the llm subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("left", ["nothing", "folder", "pipeline"])
def test_entry_without_llm(tmp_path, left):
    """With both llm folders deleted, whatever else of it is left, the other queries and their SQL are there."""
    for name in ("inkstone", "tests"):
        shutil.copytree(ROOT / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if left == "folder":
        (tmp_path / "inkstone/llm/__pycache__").mkdir(parents=True)
    if left == "pipeline":
        (tmp_path / "corpus_pipeline.py").write_text("import inkstone.llm.jaccard\n")
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert q and o.keys() <= q.keys(); assert not [n for n in q if n.startswith('op') or n == 'pipeline']"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_every_oracle_has_its_query():
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as entry

    assert entry.oracle_sql().keys() <= entry.queries().keys()
