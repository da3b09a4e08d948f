import importlib
import sys


def test_contract(spark):
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert len(queries) > 100 and not sql.keys() - queries.keys()
    assert entry.entry(spark).columns == ["snap_no", "volume_id", "full_path", "change"]


def test_works_without_the_optional_subpackage(monkeypatch):
    monkeypatch.setitem(sys.modules, "siltstone.llm", None)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    entry = importlib.import_module("__spark_entry__")
    assert entry.llm_queries is None and "p3_found" in entry.queries() and "p2_found" not in entry.queries()
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
