"""Audits as documents arrive: each micro-batch of entity rows is audited and its findings appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.plans.audit import Corpus
from lectern.schema import ENTITIES


def audit_stream(spark: SparkSession, arriving: str, entities: str, out: str, checkpoint: str, rules: list[str] | None = None):
    """Start a query over document rows that appear under arriving (parquet).

    entities holds the other entity tables; a batch reads only the rows of its own documents.
    Each batch writes out/batch=N anew, so a batch that runs again after a failure replaces itself."""

    def each(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession  # a micro-batch lives in a session of its own, and so must its views
        frames = {"documents": batch.persist()}
        for name in ENTITIES:
            if name != "documents":
                frames[name] = own.read.schema(ENTITIES[name]).parquet(f"{entities}/{name}").join(frames["documents"].select("doc_id"), "doc_id", "left_semi")
        Corpus(own, frames).audited(f"{out}/batch={number}", rules)
        batch.unpersist()

    stream = spark.readStream.schema(ENTITIES["documents"]).parquet(arriving)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
