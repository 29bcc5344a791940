"""Every named query against its SQL, on the smallest tables."""

import duckdb
import pytest

from spanlight.plans import catalog

from .compare import connect, same

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, con, name):
    same(catalog.queries()[name](spark, SF), con, catalog.oracle_sql()[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(catalog.oracle_sql()) <= set(catalog.queries()) <= set(entry.queries())


def test_averages_just_below_a_whole_number(spark, tmp_path):
    """Averages are floored as they are, not after rounding: 72.99999999999999 is 72, as in SQL."""
    source = connect(SF)
    for name in ("orders", "lineitem"):
        source.execute(f"COPY {name} TO '{tmp_path}/{name}.parquet'")
    values = "[136.42, 69.48, 13.1, 9.99998, 9.99998]"
    source.execute(f"COPY (SELECT event_id, ts, user_id, CASE WHEN event_id % 5 < 3 THEN 'view' ELSE 'click' END AS event_type, {values}[event_id % 5 + 1]::DOUBLE AS value, props FROM events ORDER BY event_id) TO '{tmp_path}/events.parquet'")
    con = duckdb.connect()
    for name in ("orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    out = catalog.queries()["table_traces_scores"](spark, str(tmp_path))
    assert {r["scores_avg"] for r in out.collect()} == {"click=9,view=72", None}
    same(out, con, catalog.oracle_sql()["table_traces_scores"])
