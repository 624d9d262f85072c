"""Arriving feature files as a stream, with what is stored already skipped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from clipquery.sources.features import TEXTUAL


def arriving(spark: SparkSession, folder: str, schema: str = TEXTUAL) -> DataFrame:
    """Features of JSON files as they appear under a folder."""
    return spark.readStream.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(folder)


def store_new(features: DataFrame, table: str, checkpoints: str, key: str = "segment_id") -> StreamingQuery:
    """Append each batch's rows to a Parquet folder but for keys that it holds, then end.

    A batch that is run again after a failure finds its rows stored and adds nothing, so each key is stored once. Only
    the key column of the stored table is read.
    """

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
        new = batch.filter(F.col(key).isNotNull()).dropDuplicates([key])
        if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
            new = new.join(spark.read.schema(batch.schema).parquet(table).select(key), key, "left_anti").select(*batch.columns)
        new.write.mode("append").parquet(table)

    return features.writeStream.foreachBatch(add).option("checkpointLocation", checkpoints).trigger(availableNow=True).start()
