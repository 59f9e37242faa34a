"""The driver contract without the corpus part."""

import importlib

import __spark_entry__ as entry


def test_core_queries_without_the_corpus_part(monkeypatch):
    whole = importlib.import_module

    def without(name, *args):
        if name.startswith("lettermill.llm"):
            raise ImportError(name)
        return whole(name, *args)

    monkeypatch.setattr(importlib, "import_module", without)
    names = set(entry.queries())
    assert "phone_canonical" in names and not any(n.startswith("op") and n[2:3].isdigit() for n in names)
    assert set(entry.oracle_sql()) <= names
