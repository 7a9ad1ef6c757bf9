import importlib.util
import inspect
import re
from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")


def test_registration():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert oracles.keys() <= queries.keys() and len(queries) > 60
    has_llm = importlib.util.find_spec("sheetloom.llm") is not None
    assert {f"p{n}_found" for n in ((1, 2, 3, 4, 5, 8) if has_llm else (4, 5))} <= queries.keys()
    for f in queries.values():
        assert list(inspect.signature(f).parameters)[0] == "spark"


def test_nothing_else_imports_the_text_subpackage():
    root = Path(entry.__file__).parent / "sheetloom"
    users = [p for p in root.rglob("*.py") if "llm" not in p.parts and re.search(r"^\s*(from|import) +sheetloom\.llm|import_module", p.read_text(), re.M)]
    assert users == []


@pytest.mark.skipif(not DATA.exists(), reason="no test data here")
def test_the_flagship_query_runs(spark):
    assert entry.entry(spark).columns == ["source_id"] and entry.entry(spark).count() > 0
