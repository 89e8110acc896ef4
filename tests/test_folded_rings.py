"""Edges that lie on each other count as in the SQL, which compares signs of cross products of about 1e-13."""

import duckdb
import oracle

from rastrel.plans import catalog


def test_folded_edges_on_each_other(spark, tmp_path):
    rows = " UNION ALL ".join(f"SELECT {n} AS user_id, i FROM range({n}) t(i)" for n in range(12, 122, 2))
    duckdb.execute(
        f"COPY (SELECT row_number() OVER (ORDER BY user_id, i) AS event_id, TIMESTAMP '2024-01-01' + INTERVAL (i) SECOND AS ts, CAST(user_id AS BIGINT) AS user_id, "
        f"CAST((i * 37 + user_id) % 11 * 20 AS DOUBLE) AS value FROM ({rows})) TO '{tmp_path}/events.parquet'"
    )
    name = "self_intersections"
    assert oracle.differences(catalog.queries()[name](spark, str(tmp_path)), oracle.connect(str(tmp_path)), catalog.oracle_sql()[name]) == ""
