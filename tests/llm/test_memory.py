"""What a Python worker holds: it stands beside its executor, and counts as the executor's memory."""

import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from bulletin.llm import bpe, toxicity


def test_terms_of_a_large_batch_take_little_memory():
    batch = pa.RecordBatch.from_arrays([pa.array([" ".join(f"word{(i * 7 + k) % 9973}," for k in range(2000)) for i in range(300)])], ["text"])
    assert batch.nbytes > 4 << 20
    tracemalloc.start()
    try:
        rows = sum(len(b) for b, *_ in toxicity.counted(batch, 0))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == 300 and peak < 64 << 20


def test_toxicity_keeps_no_tables_of_tokens_in_its_workers(spark):
    """Idle workers are handed out in turn: each of them gets a task of 32."""

    def held(batches):
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([bpe.load.cache_info().currsize])], ["n"])

    docs = spark.range(320).select(F.col("id").alias("doc_id"), F.concat(F.lit("calm words "), F.col("id")).alias("text")).repartition(32)
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    most = lambda: max(r.n for r in spark.range(32).repartition(32).mapInArrow(held, "n long").collect())
    assert bpe.digests(docs).count() == 320 and most() == 1
    assert len(toxicity.score(docs, labels).collect()) == 320 and most() == 0
