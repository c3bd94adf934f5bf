import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_names_match():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(oracles) > 90


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert rows and all(0 <= r.recall <= 1 and r.fn <= r.n for r in rows)
    assert [r.recall for r in rows] == sorted(r.recall for r in rows)


def test_works_without_the_training_data_subpackage():
    code = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("arborlane.llm") or name == "corpus_pipeline":
            raise ImportError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert "flagship" in e.queries() and "pipeline" not in e.queries() and not any(n.startswith("op1_") for n in e.queries())
assert set(e.oracle_sql()) <= set(e.queries())
"""
    subprocess.run([sys.executable, "-c", code], check=True, capture_output=True)


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "arborlane").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text()
