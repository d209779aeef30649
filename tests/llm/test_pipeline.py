"""The pipeline against a brute-force version of its stages, and the registered queries."""

import os

import duckdb
import pytest

import corpus_pipeline
from carrierbook.llm import queries, secret_scan
from tests.llm.test_rule_operators import _base
from tests.llm.test_text_operators import _components, _copies

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, docs, tmp_path):
    seen = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r["doc_id"], r["text"]) for r in seen.select("doc_id", "text").collect()]
        stage(spark, seen, SF).write.parquet(str(tmp_path / f"{k}"))
        after = spark.read.parquet(str(tmp_path / f"{k}"))
        if name != "packing":
            assert after.columns == docs.columns
            ids = sorted(r["doc_id"] for r in after.collect())
        if name == "quality_rules":
            assert set(ids) <= {i for i, t in before if not _base(t or "")[5]}
            assert len(ids) > 0.7 * len(before)
        elif name == "exact_dedup":
            assert ids == sorted(row[0] for row in _copies(before) if row[3])
        elif name == "ngram_join":
            assert ids == sorted(i for i, _, c in _components(before) if i == c)
        elif name == "secret_scans":
            assert ids == sorted(i for i, _ in before)
            assert secret_scan.secret_rows(after).where("n_assign + n_access + n_hex > 0").count() == 0
        else:
            assert {r["doc_id"] for r in after.collect()} == {i for i, _ in before}
        seen = after


def test_run_and_empty_table(spark, docs, tmp_path):
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert corpus_pipeline.run(spark, SF).count() > 100


def test_odd_rows_pass_through(spark, odd, tmp_path):
    seen = odd
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen, SF).write.parquet(str(tmp_path / f"{k}"))
        seen = spark.read.parquet(str(tmp_path / f"{k}"))
    assert seen.count() > 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracles(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        path = f"{SF}/{table}.parquet"
        con.execute(f"create view {table} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = con.execute(queries.ORACLE_SQL[name])
    order = [d[0] for d in want.description]
    assert sorted(order) == columns
    expected = sorted(map(str, ([row[order.index(c)] for c in columns] for row in want.fetchall())))
    assert sorted(map(str, ([row[c] for c in columns] for row in got.collect()))) == expected
