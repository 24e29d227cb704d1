import os

import duckdb
import pytest
from lodequery.plans.oracle import oracle_sql
from lodequery.plans.registry import queries

AT = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(AT), reason="needs the test tables")


def _rows(frame):
    columns = sorted(frame.columns)
    text = frame[columns].map(lambda v: "~" if v is None or v != v else str(int(v)) if isinstance(v, float) and v == int(v) else str(v))
    return sorted(map(tuple, text.to_numpy().tolist()))


@pytest.mark.parametrize("name", ["stem_vocab", "postings", "build_index", "bm25_batch", "suggest", "dedup_pages", "upsert_documents", "crawl_errors", "robots_verdicts", "token_offsets"])
def test_plans_match_sql(spark, name):
    db = duckdb.connect()
    db.sql("SET TimeZone = 'UTC'")
    for file in os.listdir(AT):
        db.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{AT}/{file}'")
    expected = db.sql(oracle_sql()[name]).df()
    assert _rows(queries()[name](spark, AT).toPandas()) == _rows(expected)


def test_every_plan_is_callable():
    assert set(oracle_sql()) <= set(queries())
    assert all(map(callable, queries().values()))


def test_the_whole_queue_is_ordered(spark):
    at = AT.replace("0.001", "0.01")
    urls = duckdb.sql(f"SELECT url, min(depth) AS depth FROM '{at}/crawl_errors.parquet' WHERE url IS NOT NULL GROUP BY url ORDER BY depth, url").fetchall()
    assert [tuple(r) for r in queries()["frontier_order"](spark, at).select("url", "depth").collect()] == urls and len(urls) > 100
