"""Model answers as a stream: new files of a folder are parsed and validated once and appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from adatlas.operators import answers as A
from adatlas.sources.shared import DROP_SHUFFLES, settings
from adatlas.sources.tables import RESPONSES

#: Signatures that were met stand in a store on disk, of which a batch writes only what it changes. What a batch was dealt by goes with its end.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.compression.codec": "zstd",
    **DROP_SHUFFLES,
}


def signed(responses: DataFrame) -> DataFrame:
    """Answers without a signature are told by their issue and spread."""
    return responses.withColumn("signature", F.coalesce("signature", F.concat_ws(":", "issue_id", F.col("spread_no").cast("string"))))


def follow(spark: SparkSession, source: str, target: str, checkpoint: str, files_a_batch: int | None = None) -> StreamingQuery:
    """Reads what has come since the last run and ends: answers/ has each signature once, whatever is sent again; entries/ their entries.

    Known signatures are keyed state of the stream, kept with its checkpoint: a batch looks up its own signatures only,
    however many came before, and reads nothing that was stored. A batch replaces its own folders, so that a repeated
    batch adds nothing. files_a_batch: files that one batch takes at most; None for all.
    """

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").option("compression", "zstd").parquet(f"{target}/answers/batch={number}")
        kept = batch.sparkSession.read.schema(batch.schema).parquet(f"{target}/answers/batch={number}")
        A.validated(A.parsed(kept)).write.mode("overwrite").option("compression", "zstd").parquet(f"{target}/entries/batch={number}")

    reader = spark.readStream.schema(f"{RESPONSES}, signature STRING")
    stream = signed((reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader).json(source))
    with settings(spark, STATE):  # the query takes the settings that it finds when it starts
        return stream.dropDuplicates(["signature"]).writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
