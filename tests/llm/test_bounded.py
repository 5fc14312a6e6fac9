"""Batches of the pipeline's stages are bounded by bytes."""

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerline.llm.common import BATCH_BYTES


def test_batches_of_a_stage_are_bounded(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    docs = spark.range(0, 8000, 1, 1).select(
        F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("word "), F.col("id").cast("string")), 400).alias("text"))
    try:
        corpus_pipeline.near_dedup(spark, docs.limit(3), "")
        sizes = docs.mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in bs), "n long")
        assert max(r["n"] for r in sizes.collect()) <= 2 * BATCH_BYTES
    finally:
        spark.conf.set(key, before)
