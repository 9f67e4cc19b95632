"""The ingestion log as one table: a record per entity, by day and batch.

A batch writes its records as QUEUED first and replaces them by the final ones, with their change sets, when it is done:
the partitions of a batch are its own, so the table has the latest record of every id at any time, and a repeated batch
replaces what it wrote. A time filter prunes days; nothing has to be merged to read the log.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshledger.operators.flatten import DELIVERY
from meshledger.operators.logs import day_of, with_log_key
from meshledger.schemas import LOG

PLACE = ("day", "batch")
#: Columns of the table: the log's own, which delivery of a request a record is from, and the partitions.
STORED = T.StructType([*LOG.fields, T.StructField("copy", T.IntegerType()), T.StructField("day", T.IntegerType()),
                       T.StructField("batch", T.LongType())])


def conform(records: DataFrame) -> DataFrame:
    """The log's columns in order; what records do not have is null."""
    return records.select(*[(F.col(f.name) if f.name in records.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                            for f in [*LOG.fields, STORED["copy"]]])


@dataclass(frozen=True)
class LogTable:
    path: str

    def write(self, records: DataFrame, batch: int) -> None:
        """Replace the batch's records. Ranges of (day, id) keep a day's files few and a single day in many tasks."""
        placed = conform(records).withColumn("day", day_of(F.col("ingestion_ts"))).withColumn("batch", F.lit(batch).cast("bigint"))
        placed.repartitionByRange("day", "id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            *PLACE).parquet(self.path)

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(STORED).parquet(self.path)

    def delivered(self, requests: DataFrame, batch: int) -> DataFrame | None:
        """(ingestion_ts, id, n): how often requests of these came in earlier batches; only their days are read."""
        if batch == 0:
            return None
        days = [row[0] for row in requests.select(day_of(F.col("ingestion_ts"))).distinct().collect()]
        seen = self.read(requests.sparkSession).where(F.col("day").isin(days) & (F.col("batch") < batch))
        keys = requests.select(*DELIVERY).distinct()
        found = seen.select("ingestion_ts", F.col("request_id").alias("id"), "copy").join(keys, list(DELIVERY), "left_semi")
        return found.groupBy(*DELIVERY).agg((F.max("copy") + 1).cast("bigint").alias("n"))


def to_documents(log: DataFrame) -> DataFrame:
    """(log_key, document): every record as JSON under its key, as a document store holds it."""
    return with_log_key(log).select("log_key", F.to_json(F.struct(*LOG.fieldNames())).alias("document"))


def from_documents(documents: DataFrame, document: Column | None = None) -> DataFrame:
    """Records of JSON documents, read with the whole schema."""
    text = F.col("document") if document is None else document
    return documents.select(F.from_json(text, LOG).alias("r")).select("r.*")
