"""The driver's contract, with and without the training-data operators."""

import importlib.util

import __spark_entry__ as entry
from keelson.plans import catalogue


def test_flagship(spark):
    assert entry.entry(spark).columns == ["c_nationkey", "low_stock"]


def test_names():
    assert set(catalogue.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_training_data_operators(monkeypatch):
    real = importlib.util.find_spec
    hidden = lambda name, *a: None if name.startswith("keelson.llm") or name == "corpus_pipeline" else real(name, *a)
    monkeypatch.setattr(entry, "find_spec", hidden)
    assert set(entry.queries()) == set(catalogue.QUERIES)
    assert set(entry.oracle_sql()) == set(catalogue.ORACLE_SQL)
