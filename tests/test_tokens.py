from hashlib import md5

import duckdb
import pytest

from vellumic.plans import tables as T

TEXTS = ["Élan  vital 12 kg", "\u00a0Größe:\u00a04\u2003mm\u3000", "“Straße” — 7", "ΟΔΟΣ İ", "año5 5º", "plain 39 text 39", "x\x1cy\x854", "", "\u00a0", None]
CRITICAL = {0: (1, 1), 1: (1, 1), 2: (1, 1), 5: (2, 1), 6: (1, 1)}


@pytest.fixture()
def folder(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_texts_of_any_script(spark, folder):
    got = {r.doc_id: (r.normalized, r.n_tokens) for r in T.normalize_tokens(spark, folder).collect()}
    want = {i: (md5(" ".join(t.lower().split()).encode()).hexdigest(), len(t.split())) for i, t in enumerate(TEXTS) if t is not None}
    assert got == want
    assert {r.doc_id: (r.n, r.n_distinct) for r in T.critical_tokens(spark, folder).collect()} == CRITICAL


@pytest.mark.parametrize("name", ["normalize_tokens", "critical_tokens"])
def test_equal_to_sql(spark, sf, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = {r[0]: r[1:] for r in con.execute(T.SQL[name]).fetchall()}
    got = {r[0]: tuple(r)[1:] for r in T.QUERIES[name](spark, sf).collect()}
    assert got == want
