"""Every rule over its stated cases, in Spark and in DuckDB."""

import duckdb
import pytest

from quayside.plans import catalog
from test_oracles import plain

NAMES = sorted(catalog.rules)


@pytest.mark.parametrize("part", range(8))
def test_cases(spark, part):
    con = duckdb.connect()
    for name in NAMES[part::8]:
        rule = catalog.rules[name]
        df = rule.over_cases(spark)
        got = sorted((tuple(map(plain, r)) for r in df.collect()), key=repr)
        want = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in df.columns)} FROM ({rule.cases_sql()})").fetchall()
        assert got == sorted((tuple(map(plain, r)) for r in want), key=repr), name


def test_every_rule_is_applied_to_a_whole_table():
    assert set(NAMES) <= set(catalog.queries())
