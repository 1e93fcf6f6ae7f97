"""Keeping a collection current from a folder that chunk files arrive in."""

from pyspark.sql import SparkSession, functions as F

from trawl.sources.collection import Collection
from trawl.sources.readers import CHUNK_SCHEMA


def take_batch(collection: Collection, rows, number: int, stream: str, embedder=None) -> int:
    """Put one batch of a stream into the collection, once.

    The batch's number is committed with its rows, so a batch that is sent again, because the query
    stopped between the commit and its own checkpoint, does nothing. Of chunks that repeat an id within
    a batch the one from the latest file counts.
    """
    return collection.upsert(rows, embedder, latest=("file_time", "file_name"), batch=(stream, number))


def follow_chunks(
    spark: SparkSession, folder: str, collection: Collection, checkpoint, embedder=None, **trigger
):
    """Start a query that upserts new chunk files into the collection, each exactly once.

    ``trigger`` is a writer trigger, such as processingTime="1 minute"; without
    one the query stops when it has taken in what is there. The checkpoint names the stream: one that starts
    over in a new checkpoint takes all files in again.
    """
    arriving = (
        spark.readStream.schema(CHUNK_SCHEMA)
        .json(folder)
        .select(
            F.col("chunk_id").alias("id"),
            "text",
            "metadata.*",
            F.col("_metadata.file_modification_time").alias("file_time"),
            F.col("_metadata.file_name").alias("file_name"),
        )
    )

    def upsert(batch, number):
        take_batch(collection, batch, number, str(checkpoint), embedder)

    return (
        arriving.writeStream.foreachBatch(upsert)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
