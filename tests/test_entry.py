"""The entry module with and without the training-data operators."""

import importlib
import sys

import __spark_entry__


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_runs(spark):
    assert set(__spark_entry__.entry(spark).columns) == {"image_id", "k", "t", "area", "perimeter_closed", "perimeter_open", "euler"}


def test_without_training_data_operators(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("rasterloom.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.delitem(sys.modules, "corpus_pipeline", raising=False)
    for name in ("rasterloom.llm", "corpus_pipeline"):
        monkeypatch.setitem(sys.modules, name, None)
    entry = importlib.reload(__spark_entry__)
    try:
        assert "lkc_curves" in entry.queries() and not any(n.startswith("op1") or n == "pipeline" for n in entry.queries())
    finally:
        monkeypatch.undo()
        importlib.reload(__spark_entry__)
