"""Continuous import: conversations that arrive as files are extracted once, by content."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.exports import RAW

VALUE = "key string, value string"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def arriving(spark: SparkSession, folder: str, files: int = 100) -> DataFrame:
    """A stream of raw conversations (archive, entry, input_ord, json) from table files that land in a folder."""
    return spark.readStream.schema(RAW).option("maxFilesPerTrigger", files).parquet(folder)


def import_stream(raw: DataFrame, extract: Callable[[DataFrame], DataFrame], cache: str, checkpoint: str) -> StreamingQuery:
    """Each new conversation goes through ``extract`` (key, json -> key, value) and is kept in the cache; known ones are passed over.

    What is known is the stream's own state: keys by hash partition, in RocksDB, checkpointed with the offsets. A batch looks up the keys it
    brings in their partitions and reads nothing of the cache. Each batch writes its own folder over, so one that is repeated
    after a failure leaves no second copy. Takes all that is there and ends; started again, it goes on from its checkpoint.
    """
    spark = raw.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    new = raw.select(F.sha2("json", 256).alias("key"), "json").dropDuplicates(["key"])

    def batch(df: DataFrame, number: int) -> None:
        extract(df).select("key", "value").write.mode("overwrite").parquet(f"{cache}/batch={number}")

    return new.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def cached(spark: SparkSession, cache: str) -> DataFrame:
    """key, value of all batches."""
    return spark.read.option("basePath", cache).schema(VALUE + ", batch int").parquet(cache).select("key", "value")
