"""A worker holds nothing of an operator once a task of another one begins."""

import pyarrow as pa

from tessera.llm import bpe
from tessera.llm.common import arrow_map
from tessera.llm.queries import tokenizer_path


def test_words_are_forgotten(spark):
    docs = spark.range(40).selectExpr("id as doc_id", "concat('word', id, ' some text') as text").repartition(4)

    def held(batches):
        from tessera.llm import bpe

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(bpe._lexicons) + bpe.load.cache_info().currsize] * batch.num_rows, pa.int64())], names=["id", "held"])

    for _ in range(2):
        assert {r["decoded"] for r in bpe.encode_decode(docs, tokenizer_path()).collect()} == {f"word{k} some text" for k in range(40)}
        assert {r["held"] for r in arrow_map(docs.select("doc_id"), held, "id long, held long").collect()} == {0}
