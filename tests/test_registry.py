import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import compare

SMALL = "/root/testdata/sf0.001"
# One query of every area by default; all of them with RINKFLOW_ALL=1.
CHOSEN = (
    "flatten_nested_events quarantine status_latest union_by_name shot_features shot_features_ref interval_join arena_bias "
    "sequence_anomalies_ref quality_report calibrate_season eval_auc group_folds goalie_season_metrics pct_rank kalman_projection "
    "loess_local_linear leaderboard goalie_detail card_stats shrinkage_sweep2 kalman_traded kalman_traded_last"
).split()
NAMES = list(entry.queries()) if os.environ.get("RINKFLOW_ALL") else CHOSEN


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SMALL}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    status, rows, _, note = compare(spark, con, name, SMALL)
    assert status in ("ok", "rows"), f"{status} {rows} {note}"


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_survives_a_missing_library(monkeypatch):
    """Without a tokenizer library the text queries are left out and all others stay."""
    import sys

    for name in [m for m in sys.modules if m.startswith("rinkflow.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "public_tokenizers", None)
    if os.path.exists(os.path.join(os.path.dirname(entry.__file__), "rinkflow", "llm", "queries.py")):
        with pytest.warns(UserWarning, match="can't be imported"):
            names = set(entry.queries())
    else:
        names = set(entry.queries())
    assert "leaderboard" in names and not any(n.startswith("op") and n[2].isdigit() for n in names) and "pipeline" not in names


def test_scratch_is_deleted(spark):
    from rinkflow.session import fresh_path, scratch

    kept = fresh_path(spark, "kept")
    with pytest.raises(KeyError), scratch(spark):
        inner = fresh_path(spark, "inner")
        spark.range(3).write.parquet(inner)
        with scratch(spark):
            deeper = fresh_path(spark, "deeper")
            spark.range(3).write.parquet(deeper)
        assert not os.path.exists(deeper) and os.path.exists(inner)
        spark.read.parquet(inner).write.parquet(kept)
        raise KeyError
    assert not os.path.exists(inner) and spark.read.parquet(kept).count() == 3
