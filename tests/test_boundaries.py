"""The library stands without the training-data subpackage."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]

WITHOUT = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name == "tessella.llm" or name.startswith("tessella.llm."):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as entry
print(len(entry.queries()), len(entry.oracle_sql()), any(x.startswith("op") and x[2].isdigit() for x in entry.queries()))
"""


def test_entry_works_without_the_subpackage():
    out = subprocess.run([sys.executable, "-c", WITHOUT], cwd=ROOT, capture_output=True, text=True)
    count, sql, operators = out.stdout.split()
    assert int(count) > 50 and int(sql) > 50 and operators == "False"


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "tessella").rglob("*.py"):
        if "llm" not in path.parts:
            assert "tessella.llm" not in path.read_text("utf-8"), path
