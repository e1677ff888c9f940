import pytest

import __spark_entry__ as entry


def test_entry_and_names(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["u", "v", "orientation", "weight"] and frame.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("missing,passes", [("corpus_pipeline", True), ("scaffweave.llm", True), ("some_package", False), ("scaffweave.functions.tags", False)])
def test_only_missing_corpus_operators_pass(monkeypatch, missing, passes):
    def fails(name):
        raise ModuleNotFoundError(f"No module named {missing!r}", name=missing)

    monkeypatch.setattr(entry.importlib, "import_module", fails)
    if passes:
        assert set(entry.queries()) == set(entry.scaffold.QUERIES) and set(entry.oracle_sql()) == set(entry.scaffold.ORACLE_SQL)
    else:
        with pytest.raises(ModuleNotFoundError):
            entry.queries()
