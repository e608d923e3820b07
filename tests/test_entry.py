import importlib
import sys


def test_queries_have_matching_sql():
    import __spark_entry__ as entry

    assert len(entry.queries()) > 150 and set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_llm_folder(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("sparkwave.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "sparkwave.llm", None)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    entry = importlib.import_module("__spark_entry__")
    assert "pipeline" not in entry.queries() and len(entry.queries()) > 150
    sys.modules.pop("__spark_entry__")


def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert rows and all(abs(r["peak"] - 0.9) < 1e-6 for r in rows)
