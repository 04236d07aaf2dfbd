import importlib.util
import os

import duckdb
import pandas as pd
import pytest


def load():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(os.path.dirname(__file__), "..", "__spark_entry__.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def test_names(spark):
    entry = load()
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1


FAST = ["docs_client_filter_sort", "latest_per_key", "topk_per_key", "metric_cer_by_category", "job_state_fold", "stale_jobs", "parse_layout_jsonl", "section_fill", "detect_all", "propose_evidence_aware", "fusion_summary", "alignment", "assign_greedy", "lattice_agreement", "evidence_view", "p1_found", "p1_blocks", "p1_polygon_points"]


@pytest.mark.parametrize("name", FAST)
def test_against_sql(spark, sf, name):
    entry = load()
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    got, want = entry.queries()[name](spark, sf).toPandas(), con.execute(entry.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    cell = lambda v: "-" if pd.isna(v) is True else f"{v:.6g}" if isinstance(v, float) else f"{float(v):.6g}" if isinstance(v, int) and not isinstance(v, bool) else str(v)
    rows = lambda d: sorted(tuple(cell(v) for v in r) for r in d[sorted(d.columns)].astype(object).itertuples(index=False, name=None))
    assert rows(got) == rows(want)
