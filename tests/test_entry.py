"""The driver's entry point, with and without the corpus operators."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_works_without_the_corpus_operators(tmp_path):
    for p in ROOT.iterdir():
        if p.name in ("tessera", "__spark_entry__.py"):
            subprocess.run(["cp", "-r", str(p), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "tessera/llm")], check=True)
    code = "import __spark_entry__ as e; assert 'plan_flagship' in e.queries() and not any(k.startswith('op1') or k == 'pipeline' for k in e.queries())"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})


def test_nothing_else_imports_the_corpus_operators():
    for p in (ROOT / "tessera").rglob("*.py"):
        if "llm" not in p.parts:
            assert "tessera.llm" not in p.read_text() and "from .llm" not in p.read_text()
