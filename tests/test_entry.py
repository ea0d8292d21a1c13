import importlib.util
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def entry():
    spec = importlib.util.spec_from_file_location("__spark_entry__", ROOT / "__spark_entry__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def test_registry():
    e = entry()
    q, s = e.queries(), e.oracle_sql()
    assert set(s) <= set(q) and len(q) > 120 and len(s) > 90
    for n in (1, 2, 5, 7):
        assert f"p{n}_found" in q


def test_only_the_registry_knows_the_subpackage():
    for p in (ROOT / "tripleflow").rglob("*.py"):
        if "llm" not in p.parts:
            text = p.read_text()
            assert "import llm" not in text and ".llm" not in text, p
