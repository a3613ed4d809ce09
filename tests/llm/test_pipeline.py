"""The pipeline's stages, each on its predecessor's rows."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import common, queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables are not here")


def test_stages(spark):
    docs = common.documents(spark, FOLDER)
    before = {}
    for name, stage in corpus_pipeline.STAGES:
        made = common.written(stage(spark, docs, FOLDER))
        if name == "packing":
            want = docs.agg(F.sum("n_chars")).first()[0]
            assert want and made.select("doc_id").distinct().count() == docs.count()
        else:
            assert made.dtypes == docs.dtypes
        before[name] = made.count()
        docs = made
    assert before["quality"] < common.documents(spark, FOLDER).count() and before["near_dedup"] <= before["quality"] and before["suffix_array"] == before["pii"] == before["near_dedup"]


def test_stages_on_no_rows(spark):
    docs = common.documents(spark, FOLDER).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, FOLDER).count() == 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_covers_the_table(spark, name):
    made = queries.QUERIES[name](spark, FOLDER)
    ids = made.select("doc_id").distinct().count()
    assert ids == common.documents(spark, FOLDER).count()
