"""Queries against their SQL twins on the smallest tables; the tool in tools/ runs all of them."""

import duckdb
import pytest

import __spark_entry__ as entry
from tallymark.sources.tables import TABLES

CHECKED = (
    "prj_01_deadline_state", "prj_04_constraint_violations", "flt_07_review_state", "srt_05_newest_with_blind_reset",
    "agg_05_dashboard_counters", "agg_08_model_comparison", "win_01_previous_run", "win_05_last_claims", "win_13_active_document",
    "join_10_earlier_discovery", "join_12_source_reconcile", "join_13_evidence_changes", "prj_12_state_transitions",
    "agg_19_compose_profiles", "fn_01_normalize_text", "fn_15_normalize_url", "fn_17_fingerprints", "join_09_tracked_duplicates",
    "join_21_shared_passages", "agg_13_agreement_sets", "join_17_run_comparison", "fn_28_payload_violations", "src_02_batch_upsert",
    "str_02_listing_lifecycle", "str_04_period_counters",
)


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    tidy = lambda v: float(f"{v:.9g}") if isinstance(v, float) else v
    return sorted((tuple(tidy(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, sf, name):
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    result = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    frame = entry.queries()[name](spark, sf)
    assert sorted(frame.columns) == sorted(names)
    assert plain([tuple(r) for r in frame.collect()], frame.columns) == plain(result.fetchall(), names)
