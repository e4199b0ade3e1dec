"""The entry gives the library's queries whether or not the corpus part can be imported."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parent.parent
CODE = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == {name!r} or name.startswith({name!r} + "."):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
q, s = e.queries(), e.oracle_sql()
assert "item_sections_all" in q and "item_sections_all" in s and not any(n.startswith("op") for n in q if n[2:3].isdigit()), list(q)
assert "pipeline" not in q
"""


@pytest.mark.parametrize("name", ["paperloom.llm", "ahocorasick", "xxhash"])
def test_queries_without_the_corpus_part(name):
    done = subprocess.run([sys.executable, "-c", CODE.format(name=name)], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
