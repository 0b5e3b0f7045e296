"""The registered queries against their SQL, and the pipeline's stages against the operators' promises."""

import corpus_pipeline
import pytest
from compare import compare, contract
from pyspark.sql import functions as F

from ferrywell.llm import queries
from ferrywell.session import Staged

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    assert name in contract.queries()
    assert compare(spark, con, name, SMALL) == []


def test_stages_follow_each_other(spark):
    docs = first = spark.read.parquet(f"{SMALL}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = Staged(stage(spark, docs, SMALL), name).df
        assert docs.columns == first.columns
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert pieces.select("doc_id").distinct().count() == docs.count()
    tokens = pieces.groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("n"))
    assert tokens.where("n != doc_tokens").isEmpty()


def test_run_gives_the_last_stage(spark):
    assert "sequence_id" in corpus_pipeline.run(spark, SMALL).columns
