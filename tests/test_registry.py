import ast
from pathlib import Path

import __spark_entry__ as E

ROOT = Path(__file__).resolve().parent.parent


def test_every_sql_has_its_query():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) > 50


def test_nothing_else_imports_llm():
    for path in (ROOT / "strandloom").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), path
