"""The driver's contract: names match, some queries equal their SQL, and nothing needs the llm folders."""

from __future__ import annotations

import datetime
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from quayline.plans.queries import ORACLE_SQL, QUERIES

ROOT = Path(__file__).resolve().parents[1]
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 4)
    return float(v) if type(v).__name__ == "Decimal" else v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else v


@pytest.mark.parametrize("name", ["shipment_curated", "event_quarantine", "route_rankings", "dq_mask_counts", "event_lookback_3d", "psi_numeric_ties", "psi_categorical_nulls", "classification_metrics", "stream_dedup_daily", "lax_casts", "strict_timestamps", "token_cost", "contract_violations", "dq_all_checks", "shipment_history", "route_stats", "column_profile", "fold_members", "route_quarterly_stats", "route_rankings_quarter_asc", "single_route_stats", "empty_route_stats", "history_features", "dq_transit_outlier", "sorted_lookup", "sorted_deep_page", "seek_page", "shipment_details", "keyed_merge", "late_rows", "rare_categories"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df, sql = QUERIES[name](spark, SF), con.sql(ORACLE_SQL[name])
    names = sorted(df.columns)
    assert sorted(sql.columns) == names
    got = sorted(repr([plain(r[c]) for c in names]) for r in df.collect())
    assert got == sorted(repr([plain(r[sql.columns.index(c)]) for c in names]) for r in sql.fetchall())


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_all_else_works_without_llm(tmp_path):
    shutil.copytree(ROOT / "quayline", tmp_path / "quayline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'route_stats' in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
