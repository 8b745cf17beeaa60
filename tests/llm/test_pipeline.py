"""The pipeline's stages and the queries that SQL can check."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tallyweave.llm import common, queries

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = common.table(spark, SF, "documents")
    columns, n = docs.columns, docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = common.written(spark, stage(spark, docs, SF), "stage")
        assert 0 < docs.count() <= n
        n = docs.count()
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
    assert docs.filter("NOT round_trip").count() == 0


def test_stages_on_an_empty_table(spark):
    docs = common.table(spark, SF, "documents").filter("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = common.written(spark, stage(spark, docs, SF), "stage")
    assert docs.count() == 0


def test_stages_on_odd_rows_beside_any_columns(spark):
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    texts = [None, "", " ", "one two", "é 漢字 🙂 x", long, long, long + " end", "mail a@b.cd " * 300, *(f"clean text number {i} of a few" for i in range(12))]
    rows = [(i if i % 4 else None, t, "en", "s", 1) for i, t in enumerate(texts)] + [(1, "", "en", "s", 1), (7, long + " end", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("row", "id", "key", "doc", "__row", "__base", "seed", "own", "spans", "class_id", "toxic", "k1"):
        docs = docs.withColumn(name, docs.lang)
    columns, kept = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = common.written(spark, stage(spark, docs, SF), "stage")
        kept.append(docs.count())
        assert k == 4 or docs.columns == columns
    # of the three long texts one stays, and one of the two rows (1, "")
    assert kept[0] == len(rows) and kept[1] == len(rows) - 4 and kept[2:] == [kept[1]] * 3


def test_entry_has_all_queries():
    names = entry.queries()
    assert {f"op{n}" for n in range(1, 11)} <= {n.split("_")[0] for n in names} and "pipeline" in names


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    cursor = con.execute(queries.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall())
