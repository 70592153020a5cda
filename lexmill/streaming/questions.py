"""An extension: answering questions as files of them arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lexmill import schemas
from lexmill.plans.answer import answer_batch


def answer_stream(spark: SparkSession, source: str, sink: str, checkpoint: str, graph: dict[str, DataFrame]) -> StreamingQuery:
    """Each micro-batch of JSON questions under ``source`` is answered as one plan and added to ``sink``."""
    stream = spark.readStream.schema(schemas.QUESTIONS).json(source)

    def run(batch: DataFrame, number: int) -> None:
        answer_batch(batch, graph).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
