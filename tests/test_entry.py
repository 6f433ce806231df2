import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

REPO = Path(__file__).resolve().parents[1]


def test_contract(spark):
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and all(callable(q) for q in queries.values())
    assert entry.entry(spark).count() > 0


def test_imports_without_the_corpus_part():
    code = (
        "import sys, importlib.abc\n"
        "class Gone(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith(('quaestor.llm', 'corpus_pipeline')): raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "names = e.queries()\n"
        "assert 'tfidf_topk' in names and not any(n.startswith(('op', 'pipeline')) for n in names)\n"
        "assert 'tfidf_topk' in e.oracle_sql()\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True, timeout=120)


def test_nothing_else_imports_the_corpus_part():
    for path in REPO.rglob("*.py"):
        parts = path.relative_to(REPO).parts
        if "llm" in parts or parts[0] in ("corpus_pipeline.py", "__spark_entry__.py") or path.name == "test_entry.py":
            continue
        assert "quaestor.llm" not in path.read_text() and "corpus_pipeline" not in path.read_text(), path
