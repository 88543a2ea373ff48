"""The driver's contract."""

import pathlib
import re
import shutil
import subprocess
import sys

import pytest

import __spark_entry__

ROOT = pathlib.Path(__spark_entry__.__file__).parent


def test_queries_and_sql():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 50
    assert all(callable(q) for q in queries.values()) and all(re.match(r"(?i)\s*(with|select)", s) for s in sql.values())


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_the_text_folders(tmp_path, pipeline):
    """Without the text folders, with and without the pipeline's file, the sequence queries are all there."""
    shutil.copytree(ROOT / "seqtide", tmp_path / "seqtide", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py", *(["corpus_pipeline.py"] if pipeline and (ROOT / "corpus_pipeline.py").exists() else [])]:
        shutil.copy(ROOT / name, tmp_path)
    code = "import __spark_entry__ as e; from seqtide import queries as q; assert set(e.queries()) == set(q.QUERIES) and set(e.oracle_sql()) == set(q.ORACLES)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_sequence_modules_do_not_need_the_text_subpackage():
    import ast

    root = ROOT / "seqtide"
    for path in root.rglob("*.py"):
        if "llm" in path.relative_to(root).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n for n in names), path
