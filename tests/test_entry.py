"""Registered queries against their SQL in DuckDB, on the smallest tables."""

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from seqharvest import registry

DATA = "/root/testdata/sf0.001"
NAMES = ["dataset_stats", "root_lists", "eucs_i", "mine_hausp", "level_profile", "swu_append_delta", "append_l2_counts", "append_update", "update_profile", "maintenance_export", "retail_build", "pattern_support", "batch_split_floor", "compact_order", "item_total_rank", "eucs_append_delta_i", "eucs_append_delta_self", "depth_profile", "xi_grid", "append_two_parts", "maintenance_root_entries", "prelarge_patterns", "prelarge_kept_patterns", "prelarge_decision", "raw_sequences", "raw_sequence_lines", "maintenance_lines", "dictionary_codes", "topk_hausp", "mine_hausp_pair_filter", "incremental_hausp", "audit_runs", "run_medians"]


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(df.astype({c: str for c in df.columns if df[c].dtype == object}).itertuples(index=False), key=str)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("orders", "lineitem", "part", "events", "customer"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = rows(registry.queries()[name](spark, DATA).toPandas()), rows(con.sql(registry.oracle_sql()[name]).df())
    assert len(got) == len(want)
    for a, b in zip(got, want):
        for x, y in zip(a, b):
            assert x == y or (isinstance(x, float) and np.isclose(x, float(y), rtol=1e-12, equal_nan=True)), name


@pytest.mark.parametrize("name", ["incremental_hausp", "tree_hausp"])
def test_last_batch_covers_every_customer(spark, name):
    got = registry.queries()[name](spark, DATA).toPandas()
    assert set(got.batch_id) == {0, 1, 2, 3}
    assert rows(got[got.batch_id == 3].drop(columns="batch_id")) == rows(registry.queries()["mine_hausp"](spark, DATA).toPandas())


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["pattern", "len", "utility", "avg_utility", "support"]
