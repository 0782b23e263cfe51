"""Registered queries against their SQL in DuckDB, over the smallest tables."""

from __future__ import annotations

import math
import os
import sys
from collections import Counter

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tickloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
#: One or more of each family: the driver compares all.
GROUPS = ("sig_bear", "sig_bull", "sig_rules", "sig_crypto", "sig_volatility", "sig_breakouts", "select_c", "select_s", "news_aggregated", "news_annotated", "social_platforms", "feat_scaled", "feat_market", "trading_", "order_fills", "order_checks", "scalar_", "vol_garman", "vol_yang", "quality_c", "quality_q", "risk_metrics", "risk_sizes", "state_history", "state_order", "state_ledger", "stream_unseen", "sig_shape", "sig_size", "candles_", "checks_", "risk_compound", "risk_summary", "scan_breakout_preset", "scan_momentum_preset", "text_known", "text_market", "vector_d", "stream_feed", "stream_book", "source_routing", "seq_adx", "seq_para", "regime_decision", "ind_trend", "order_stop")


def value(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    return x


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n in registry.oracle_sql() if n.startswith(GROUPS)])
def test_query_is_its_sql(spark, con, name):
    frame = registry.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    got = Counter(tuple(value(row[c]) for c in columns) for row in frame.collect())
    cursor = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = Counter(tuple(value(row[names.index(c)]) for c in columns) for row in cursor.fetchall())
    assert got == want
