import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent

BLOCKED = """
import sys
class Block:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("strandloom.llm"):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Block())
import __spark_entry__ as e
assert "canonical_minimizers" in e.queries() and not any(n.startswith("op") and n[2].isdigit() for n in e.queries())
assert set(e.oracle_sql()) <= set(e.queries())
"""


def test_entry_works_without_the_training_data_folders():
    subprocess.run([sys.executable, "-c", BLOCKED], cwd=ROOT, check=True)


def test_nothing_outside_imports_them():
    for p in (ROOT / "strandloom").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT / "strandloom").parts:
            assert "strandloom.llm" not in p.read_text() and "from .llm" not in p.read_text(), p


def test_sql_matches_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
