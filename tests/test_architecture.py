"""Layers, imports and the driver's contract."""

import ast
import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def imports(path):
    for node in ast.walk(ast.parse(path.read_text())):
        if isinstance(node, ast.Import):
            yield from (a.name for a in node.names)
        elif isinstance(node, ast.ImportFrom) and node.module:
            yield node.module


def test_nothing_imports_the_corpus_operators():
    for path in (ROOT / "ravelin").rglob("*.py"):
        if "llm" not in path.parts:
            assert not any(m.startswith("ravelin.llm") or m == "corpus_pipeline" for m in imports(path)), path


def test_layers_look_down_only():
    order = {"sources": 0, "functions": 0, "operators": 1, "streaming": 2, "plans": 3}
    for layer, level in order.items():
        for path in (ROOT / "ravelin" / layer).glob("*.py"):
            for m in imports(path):
                parts = m.split(".")
                if parts[0] == "ravelin" and len(parts) > 1 and parts[1] in order:
                    assert order[parts[1]] <= level, (path, m)


def test_queries_can_be_listed_without_a_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q), set(o) - set(q); print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(ROOT)})
    assert out.returncode == 0 and int(out.stdout) > 100, out.stderr


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) == 1 and rows[0].days > 2000
