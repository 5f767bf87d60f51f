import duckdb
import pytest

import corpus_pipeline
from glyphmill.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_shrink(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before = {r.doc_id for r in docs.collect()}
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
            docs = corpus_pipeline.written(out, f"test-{i}")
            after = {r.doc_id for r in docs.collect()}
            assert after <= before
            if i == 0:
                gone = [labels[d].quality for d in before - after if d in labels]
                assert gone and sum(q == 0 for q in gone) >= 0.9 * len(gone)
            before = after
        else:
            assert out.count() == docs.count()


def test_stages_of_no_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[1:]:  # the classifier needs rows to learn from
        out = stage(spark, docs, SF)
        assert out.count() == 0


def test_repeated_rows_and_ids_go_through(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    twice = docs.unionByName(docs.limit(40)).unionByName(docs.limit(20).withColumn("doc_id", docs.doc_id * 0))
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        twice = corpus_pipeline.written(stage(spark, twice, SF), f"twice-{i}")
        assert twice.columns == docs.columns and twice.count() > 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    cur = db.execute(queries.oracle_sql()[name])
    cols = sorted(d[0] for d in cur.description)
    at = [[d[0] for d in cur.description].index(c) for c in cols]
    want = sorted(repr([r[i] for i in at]) for r in cur.fetchall())
    df = queries.queries()[name](spark, SF)
    assert sorted(df.columns) == cols
    assert sorted(repr([r[c] for c in cols]) for r in df.collect()) == want
