"""A spread of queries against their SQL on the smallest tables; compare.py runs them all."""

from __future__ import annotations

import os

import pytest

import __spark_entry__
from tests.compare import difference, views
from vitrine.queries import load

FOLDER = "/root/testdata/sf0.001"
NAMES = [
    "p2_features", "p2_states", "p5_found", "p5_product_stats", "p5_user_stats", "p6_found", "p6_orphan_counts", "upsert_latest", "insert_ignore", "clean_string", "parse_epoch", "union_3ch",
    "leave_last_split", "kcore", "hybrid_search_rrf", "rec_fuse_weighted", "metric_bundle", "popularity_per_user", "personalized_rerank", "rank_features", "stream_dedup", "dense_index",
]


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    return views(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    assert difference(__spark_entry__.queries()[name](spark, FOLDER), __spark_entry__.oracle_sql()[name], con) == ""


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_probed_recall_is_at_least_nine_tenths(spark, folder):
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    r = [x.recall for x in __spark_entry__.queries()["ann_probed_recall"](spark, folder).collect()]
    assert r and sum(r) / len(r) >= 0.9, sum(r) / len(r)


def test_entry_and_names(spark):
    core = load()
    assert set(core.sql) <= set(core.queries)
    assert set(core.queries) <= set(__spark_entry__.queries())
    if os.path.isdir(FOLDER):
        assert __spark_entry__.entry(spark).columns == ["query_id", "rank", "product_id", "title"]
