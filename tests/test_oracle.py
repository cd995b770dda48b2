"""Every registered query with check SQL agrees with DuckDB on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest
from conftest import SF_DIR

from tools.check_oracle import TABLES, canonical_rows
from tracelode.plans.catalog import ORACLES, QUERIES

# Queries whose rounds take long even on small tables run in tools/check_oracle.py only.
SLOW = {
    "finding_summary", "promote_shared_helpers", "expand_neighbours", "render_context", "target_rank",
    "module_describe", "compose_package", "transitive_dependents", "stream_requests",
}


@pytest.mark.parametrize("name", sorted(set(ORACLES) - SLOW))
def test_matches_sql(spark, name):
    frame = QUERIES[name](spark, SF_DIR)
    rows = [tuple(row) for row in frame.collect()]
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    wanted = connection.sql(ORACLES[name])
    assert sorted(frame.columns) == sorted(wanted.columns)
    assert canonical_rows(frame.columns, rows) == canonical_rows(wanted.columns, wanted.fetchall())


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
