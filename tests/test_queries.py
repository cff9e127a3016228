"""Every query of the library proper against its SQL; those without SQL have to return rows."""

from __future__ import annotations

import pytest

from lanternq.plans import all_queries
from verify_queries import canonical, views


@pytest.mark.parametrize("name", [n for n in all_queries.QUERIES if n not in ("hybrid_search", "eval_sweep")])
def test_query(spark, sf, name):
    got = all_queries.QUERIES[name](spark, sf).toPandas()
    if name not in all_queries.SQL:
        assert len(got)
        return
    want = views(sf).sql(all_queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_entry_imports_and_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_hybrid_search(spark, sf):
    rows = all_queries.QUERIES["hybrid_search"](spark, sf).collect()
    assert rows and {r["id"] for r in rows} >= {0}
    for r in rows:
        assert r["start"] <= r["end"] and len(r["chunk_ids"]) == r["end"] - r["start"] + 1
