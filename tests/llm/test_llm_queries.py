"""The registered llm queries against their SQL twins, or for rows."""

from __future__ import annotations

import pytest

from leakscope.llm import oracles, queries

TWINS, ALL = oracles.oracle_sql(), queries.queries()


@pytest.mark.parametrize("name", sorted(ALL))
def test_query(name, spark, sf_dir, twin):
    df = ALL[name](spark, sf_dir)
    if name in TWINS:
        twin(df, TWINS[name])
    else:
        assert df.count() > 0
