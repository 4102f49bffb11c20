"""The registered queries against their SQL twins, and the pipeline stage by stage."""

import pytest

import corpus_pipeline
from barloom.llm.queries import ORACLE_SQL, QUERIES, table
from oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SF_DIR), con, ORACLE_SQL[name]) is None


def test_pipeline(spark):
    docs = table(spark, SF_DIR, "documents")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR).cache()
        counts.append(docs.count())
        if name != "byte_bpe":
            assert docs.columns == columns
    assert counts == sorted(counts, reverse=True) and counts[-1] == counts[-2] > 0
    again = corpus_pipeline.run(spark, SF_DIR)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, docs.collect()))


def test_pipeline_on_an_empty_table(spark, tmp_path):
    for name in ("documents", "benchmark"):
        table(spark, SF_DIR, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
