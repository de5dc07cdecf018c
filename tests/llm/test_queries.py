"""The registered corpus queries against their SQL, and the pipeline's stages on their own input."""

import pytest

from candela.llm import queries
from tests.conftest import SMALL, normal


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SMALL)
    rows = [tuple(r) for r in df.collect()]
    if name in queries.ORACLES:
        result = duck.execute(queries.ORACLES[name])
        columns = [c[0] for c in result.description]
        assert sorted(columns) == sorted(df.columns) and normal(rows, df.columns) == normal(result.fetchall(), columns)


def test_pipeline(spark, tricky, empty):
    import corpus_pipeline as pipeline

    docs = tricky
    for name, stage in pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SMALL)
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == before.columns
            assert docs.count() <= before.count() or name == "source_mixing"
            assert {r["doc_id"] for r in docs.select("doc_id").collect()} <= {r["doc_id"] for r in before.select("doc_id").collect()}
    assert {10, 13}.issubset({r["doc_id"] for r in docs.select("doc_id").collect()})
    docs = empty
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
    assert docs.count() == 0
    assert pipeline.run(spark, SMALL).count() > 0
