"""One query for each operator, none without its number."""

import re

import __spark_entry__ as entry
from memspark.llm import queries


def test_each_operator_has_one_query():
    numbers = sorted(int(re.fullmatch(r"op(\d+)_[a-z0-9_]+", n)[1]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14))
    assert set(queries.ORACLE) <= set(queries.QUERIES) <= set(entry.queries()) and "pipeline" in entry.queries()
