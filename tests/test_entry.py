import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_gives_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_library_stands_without_the_llm_folders(tmp_path):
    """As after a removal of rivulet/llm, tests/llm and corpus_pipeline.py."""
    import shutil

    shutil.copytree(ROOT / "rivulet", tmp_path / "rivulet", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; names = e.queries(); assert 'rrf_fusion' in names and 'pipeline' not in names and not any(n.startswith('op1') for n in names); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
    for p in (ROOT / "rivulet").rglob("*.py"):
        if "llm" not in p.parts:
            assert "rivulet.llm" not in p.read_text() and "from ..llm" not in p.read_text()
