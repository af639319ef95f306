"""The entry module: names, SQL, and that nothing but the entry needs the llm folder."""

import importlib.util
import re
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]
DATA = "/root/testdata/sf0.001"


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 70


def test_core_does_not_import_llm():
    for p in (ROOT / "quire").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"(from|import) quire\.llm", p.read_text()), p


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["paragraph_id", "doc_id", "paragraph_index", "snippet", "title", "sermon_date", "city"]
    assert df.count() > 0


def test_llm_queries_are_there_if_the_folder_is():
    has = importlib.util.find_spec("quire.llm") is not None
    assert any(k.startswith("p7_") for k in entry.queries()) == has
