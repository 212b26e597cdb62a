import ast
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 5
    assert set(e.oracle_sql()) <= set(e.queries())


def test_nothing_else_imports_the_llm_subpackage():
    for path in ROOT.joinpath("reachbase").rglob("*.py"):
        if "llm" not in path.parts:
            names = [n for node in ast.walk(ast.parse(path.read_text())) for n in ([a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else [])]
            assert not any(n.startswith("reachbase.llm") for n in names), path
