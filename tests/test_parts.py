"""The two parts stay apart, and the entry module guards the optional one."""

import pathlib
import re

ROOT = pathlib.Path(__file__).resolve().parent.parent


def test_nothing_outside_imports_the_llm_part():
    own = [p for p in (ROOT / "itemloom").rglob("*.py") if "llm" not in p.parts]
    assert own and not [p for p in own if re.search(r"itemloom\.llm|from itemloom import llm", p.read_text())]


def test_queries_without_the_optional_part(monkeypatch):
    import __spark_entry__ as entry

    real = entry.importlib.import_module

    def missing(name, package=None):
        if name in ("itemloom.llm.queries", "corpus_pipeline"):
            raise ModuleNotFoundError(name=name)
        return real(name, package)

    monkeypatch.setattr(entry.importlib, "import_module", missing)
    names = set(entry.queries())
    assert "o31_topic_weakness" in names and not any(n.startswith("op") or n == "pipeline" for n in names)
    assert set(entry.oracle_sql()) <= names
