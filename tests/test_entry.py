"""The driver contract, with and without the llm subpackage."""

import importlib.util
import pathlib
import sys

import pytest

LLM = (pathlib.Path(__file__).resolve().parent.parent / "millrace" / "llm" / "__init__.py").is_file()


def test_contract():
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 90 and all(callable(q) for q in queries.values())


def test_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 200


def reload(monkeypatch, tmp_path, **absent):
    """The entry as a module of its own, beside an llm folder or none, with some imports failing."""
    import os

    here = pathlib.Path(__file__).resolve().parent.parent
    for name in [n for n in sys.modules if n.startswith(("millrace.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)
    for name in absent["modules"]:
        monkeypatch.setitem(sys.modules, name, None)
    monkeypatch.setattr(os.path, "isfile", lambda p, real=os.path.isfile: absent["there"] and real(p))
    spec = importlib.util.spec_from_file_location("entry_again", here / "__spark_entry__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def test_without_llm(monkeypatch, tmp_path):
    for modules, there in ((["corpus_pipeline"], False), (["xxhash"], True)):
        with monkeypatch.context() as patch:
            entry = reload(patch, tmp_path, modules=modules, there=there)
            names = entry.queries()
            assert "story_map" in names and "pipeline" not in names and not any(n.startswith("op1_") for n in names)
            assert set(entry.oracle_sql()) <= set(names)


@pytest.mark.skipif(not LLM, reason="needs the llm subpackage")
def test_mistakes_in_llm_do_not_pass_for_its_absence(monkeypatch, tmp_path):
    with pytest.raises(ModuleNotFoundError):
        reload(monkeypatch, tmp_path, modules=["millrace.llm.mixing"], there=True)
