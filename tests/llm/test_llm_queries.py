"""The subpackage's queries run over whole small tables, and equal their SQL where they have one."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from checking import rows_of, rows_of_sql  # noqa: E402

from heliodor.llm import queries  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, small, name):
    df = queries.QUERIES[name](spark, small)
    if name in queries.SQL:
        assert rows_of(df) == rows_of_sql(queries.SQL[name], small)
    else:
        assert df.count() >= 0


def test_nothing_else_imports_this_subpackage():
    package = Path(queries.__file__).resolve().parents[1]
    assert not [p for p in package.rglob("*.py") if "llm" not in p.relative_to(package).parts and "heliodor.llm" in p.read_text()]
