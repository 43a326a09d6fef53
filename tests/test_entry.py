import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_names_and_oracles():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and "chunk_documents" in queries and len(queries) >= 45


def test_entry_works_without_training_data_operators():
    code = (
        "import sys; sys.modules['corpus_pipeline'] = None; sys.modules['quillspark.llm'] = None\n"
        "import __spark_entry__ as e; assert 'chunk_documents' in e.queries() and not any(k.startswith('op') for k in e.queries())"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_nothing_else_imports_the_training_data_operators():
    for path in (ROOT / "quillspark").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text()
