import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["block_id", "n_factors", "raw_len", "sha"]


def test_it_works_without_the_optional_parts(tmp_path):
    code = "import __spark_entry__ as e; q = e.queries(); assert 'store_roundtrip' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q); e.oracle_sql()"
    subprocess.run(["cp", "-r", str(ROOT / "cairn"), str(ROOT / "__spark_entry__.py"), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "cairn/llm")], check=True)
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_nothing_imports_the_optional_parts():
    for p in (ROOT / "cairn").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "cairn.llm" not in p.read_text() and "corpus_pipeline" not in p.read_text()
