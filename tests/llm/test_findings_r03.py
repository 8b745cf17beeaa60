"""What the third round's findings on the corpus operators were about, in small."""

from tallyweave.llm import common, pieces


def test_workers_give_back_what_they_remember(spark):
    """pipeline: a worker that has encoded pieces holds the model and nothing of the inputs when other stages use it."""
    docs = spark.range(400, numPartitions=4).selectExpr("id AS doc_id", "concat('word', id, ' and others ', id * 7) AS text")
    assert pieces.encode_decode(spark, docs, common.tokenizer_file("piece_bpe_32k.model")).filter("NOT round_trip").count() == 0

    def held(batches):
        import pyarrow as pa

        from tallyweave.llm import pieces

        for _ in batches:
            models = pieces._models.values()
            yield pa.record_batch([pa.array([len(models)]), pa.array([sum(len(m.cache) + len(m.delta) + len(m.pair) for m in models)])], names=["models", "held"])

    rows = spark.range(4, numPartitions=4).mapInArrow(held, "models long, held long").collect()
    assert sum(r.models for r in rows) > 0 and not any(r.held for r in rows)
