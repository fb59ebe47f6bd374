"""Every registered query with a SQL twin gives the twin's rows on the smallest data."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUICK = [
    "bm25_topk", "signature_lexical", "qrels_parse", "validate_examples", "request_digest", "verdict_parse", "pack_state",
    "calibrated_pool", "scale_report_pooled", "frontier", "expected_regret", "cascade_summary", "pareto_front", "slice_report",
    "comparison_grid", "ece_by_bucket_raw", "temperature_grid_fit", "unanswered_targets", "additive_fit", "bm25_topk_indexed", "run_metrics",
    "evidence_sweep", "evidence_pairs", "fixed_anchor_rows", "fixed_anchor_verdict", "coverage_last_n_stream", "coverage_windows_stream",
    "escalation_log_stream", "verdict_cache_table", "paired_bootstrap", "signature_recall", "signature_title_lexical", "first_stage_check",
    "corpus_audit", "unplaced_candidates", "interaction_test", "anchor_recovery", "decide", "lambda_sweep", "candidate_pools",
    "verdict_cache_stats", "scorer_violations", "conformal_fit", "rolling_coverage", "lambda_ranknet", "training_slates",
]
needs_data = pytest.mark.skipif(not Path(SF).exists(), reason="driver tables not here")


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() > 0


@needs_data
@pytest.mark.parametrize("name", QUICK)
def test_twin(spark, name):
    import check

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    message, ok = check.compare(spark, con, name, SF)
    assert ok, message
