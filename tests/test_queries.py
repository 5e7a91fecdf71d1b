import glob
import math
import os

import duckdb
import pytest

from evigrain import catalog_of_queries, queries_of_records, queries_of_texts  # noqa: F401 - register the queries
from evigrain.registry import ORACLES as OWN_SQL
from evigrain.registry import QUERIES as OWN
from jobs.queries import ORACLES as JOBS_SQL
from jobs.queries import QUERIES as JOBS

QUERIES, ORACLES = OWN | JOBS, OWN_SQL | JOBS_SQL


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as from '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, bool) or v is None:
        return str(v)
    return f"{float(v):.9g}" if isinstance(v, int) or type(v).__name__ == "Decimal" else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf_dir, duck, name):
    got, want = QUERIES[name](spark, sf_dir), duck.sql(ORACLES[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    quoted = [f'"{c}"' for c in cols]
    rows = lambda rs: sorted(tuple(plain(v) for v in r) for r in rs)
    assert rows(got.select(*cols).collect()) == rows(want.select(*quoted).fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_claims_of_sharp_letters_equal_sql(spark, tmp_path):
    lines = ["Das ieß hier.", "Das ies hier.", "ＡＢ x²", "x2", "Große Straße", "GROSSE strasse", "ÄÖ ab", "ab"]
    rows = [(k, "\n".join(lines), "en", "src0", 1) for k in range(3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as from '{tmp_path}/documents.parquet/*.parquet'")
    got = QUERIES["claim_representative"](spark, str(tmp_path))
    cols = sorted(got.columns)
    want = con.sql(f"select {', '.join(cols)} from ({ORACLES['claim_representative']})").fetchall()
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(want) and len(want) > 4


def test_fusion_asks_for_all_items(spark, sf_dir, duck):
    """Each vector and each benchmark item is a query, not those with an id divisible by 100 only."""
    asked = {r[0] for r in duck.sql("select vec_id from embeddings union select item_id from benchmark").fetchall()}
    assert {r.query_id for r in QUERIES["rrf_fusion"](spark, sf_dir).select("query_id").distinct().collect()} == asked
