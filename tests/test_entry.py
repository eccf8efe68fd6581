import duckdb
import pytest

import __spark_entry__ as E
from pulseframe.sources.fixtures import BASE_TABLES


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "cpu" in df.columns


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


FAST = ["top_queries", "parse_sizes", "io_by_backend", "activity_per_minute_filled", "outlier_flags",
        "assign_labels", "snapshot_diff", "change_alerts", "tfidf", "backfill", "encode_categories"]


@pytest.mark.parametrize("name", FAST)
def test_oracle_small(spark, sf_small, name):
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    sdf = E.queries()[name](spark, sf_small)
    res = con.execute(E.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    drows = res.fetchall()
    srows = [tuple(r[c] for c in cols) for r in sdf.collect()]
    norm = lambda rows: sorted(repr(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in rows)
    assert norm(srows) == norm(drows)
