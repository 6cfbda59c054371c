import __spark_entry__ as entry


def test_queries_and_sql():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "knn_self_array" in entry.queries()


def test_without_the_corpus_operators(monkeypatch):
    import builtins

    real = builtins.__import__

    def missing(name, *args, **kwargs):
        if name.startswith(("vicinia.llm", "corpus_pipeline")):
            raise ModuleNotFoundError(name, name=name.split(".queries")[0])
        return real(name, *args, **kwargs)

    monkeypatch.setattr(builtins, "__import__", missing)
    assert not any(q.startswith("op") for q in entry.queries())
