"""Driver contract: entry runs, every oracle key is a query, and a sample of oracles match at sf0.001."""
import duckdb
import pytest

import __spark_entry__ as E
from pricesift.sources.tables import TABLES


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "rank" in df.columns


def test_oracle_keys_are_queries():
    assert set(E.oracle_sql()) <= set(E.queries())


def _norm(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", ["rank_offers", "price_stats", "candidate_offers", "url_frontier",
                                  "price_trend", "product_features", "query_features", "enhance_queries",
                                  "knn_topk", "page_fields"])
def test_oracle_matches(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    sdf = E.queries()[name](spark, sf)
    cols = sorted(sdf.columns)
    s = sorted((tuple(_norm(r[c]) for c in cols) for r in sdf.collect()), key=repr)
    cur = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(dcols) == cols
    idx = [dcols.index(c) for c in cols]
    d = sorted((tuple(_norm(r[i]) for i in idx) for r in cur.fetchall()), key=repr)
    assert s == d
