"""Every query with SQL of the main library against DuckDB."""

import pytest

from quarry.plans import edges, language, parsing, projections, records, search, served, service, statutes, streams

CASES = [(name, plan.QUERIES[name], plan.SQL[name]) for plan in (search, language, parsing, records, service, edges, streams, projections, statutes, served) for name in plan.SQL]


@pytest.mark.parametrize("name,query,sql", CASES, ids=[c[0] for c in CASES])
def test_same_rows(name, query, sql, same):
    same(query, sql)
