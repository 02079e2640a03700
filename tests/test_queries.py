import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from postingflow import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(name, same):
    same(queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_near_of_three(spark):
    from .conftest import SF
    from .model import evaluate, positions

    expr = queries.parse_syntax("the ~ that ~ of")
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = {(i, k, *h) for i, t in docs.items() for k, h in enumerate(evaluate(expr, positions(t)) or [])}
    got = {tuple(r) for r in queries.QUERIES["search_near_three"](spark, SF).collect()}
    assert got == want and len(want) > 100


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_subpackage(tmp_path):
    """With the subpackage and the pipeline really gone, the rest imports; with something else missing it doesn't."""
    root = Path(__file__).parent.parent
    shutil.copytree(root / "postingflow", tmp_path / "postingflow", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    run = lambda: subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*e.queries())"], cwd=tmp_path, capture_output=True, text=True)
    assert run().stdout.split() == list(queries.QUERIES)
    (tmp_path / "postingflow/llm").mkdir()  # an empty folder may be left
    assert run().stdout.split() == list(queries.QUERIES)
    (tmp_path / "corpus_pipeline.py").write_text("import not_there_at_all\n")
    assert "not_there_at_all" in run().stderr
