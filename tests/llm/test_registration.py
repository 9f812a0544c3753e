"""Registration of the query modules."""

import importlib
import sys

import pytest

import __spark_entry__


def test_a_missing_dependency_of_the_language_queries_is_raised(monkeypatch):
    monkeypatch.delitem(sys.modules, "riskweave.llm.queries")
    monkeypatch.setitem(sys.modules, "riskweave.llm.bpe", None)
    monkeypatch.delattr(sys.modules["riskweave.llm"], "bpe", raising=False)
    with pytest.raises(ImportError):
        importlib.reload(__spark_entry__)
    monkeypatch.undo()
    assert "p8_ids" in importlib.reload(__spark_entry__).queries()
