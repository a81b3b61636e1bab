"""A vector store kept up to date by a stream: each micro-batch is one upsert of the parts that it touches."""

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from lodeseek.operators.store import ParquetStore


def upsert_stream(rows: DataFrame, store: ParquetStore, checkpoint: str) -> StreamingQuery:
    """Upserts a stream of store rows. A batch that is run again after a failure leaves the same rows, as keys are replaced."""

    def write(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            store.upsert(batch)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
