"""The driver's contract."""

import importlib
import re
import subprocess
import sys

from conftest import ROOT


def test_entry_gives_rows(spark, sf_dir):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_the_library_does_not_need_the_llm_half():
    code = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith(("graphloom.llm", "corpus_pipeline")):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert not any(n.startswith("op") and n[2].isdigit() for n in e.queries())
assert "pipeline" not in e.queries() and len(e.queries()) > 90
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd="/")


def test_nothing_else_imports_the_llm_half():
    for p in (ROOT / "graphloom").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"(?:from|import)\s+\S*\bllm\b", p.read_text()), p
    importlib.import_module("graphloom.session")
