"""The request stream: landing, reading in batch or stream, and messages that cannot be used."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshledger.functions.scalars import parse_timestamp
from meshledger.schemas import MESSAGE, REQUEST

BATCH_LIMIT = 100
_CORRUPT = "_corrupt"


def stamp_requests(requests: DataFrame) -> DataFrame:
    """Requests as messages, with the server's arrival time in nanoseconds."""
    now = F.unix_micros(F.current_timestamp()) * 1000
    body = F.to_json(F.struct(*[c for c in requests.columns if c != "ingestion_ts"]))
    return requests.select(body.alias("request"), now.cast("string").alias("ingestion_ts"))


def append_requests(requests: DataFrame, path: str) -> None:
    stamp_requests(requests).write.mode("append").parquet(path)


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MESSAGE).parquet(path)


def stream_messages(spark: SparkSession, path: str, max_files: int = BATCH_LIMIT,
                    start: str | None = None) -> DataFrame:
    """The landing folder as a stream, at most ``max_files`` files per batch, oldest first. With ``start``
    (``2024-01-31T12:00:00``, in the session's zone) only files written after it: a new job that wants new messages alone."""
    reader = spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", max_files)
    if start is not None:
        reader = reader.option("modifiedAfter", start)
    return reader.parquet(path)


def kafka_messages(spark: SparkSession, servers: str, topic: str, max_messages: int = BATCH_LIMIT,
                   starting: str = "latest") -> DataFrame:
    """The same from a topic; a new job starts with new messages only. Needs the Kafka connector."""
    source = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
              .option("subscribe", topic).option("maxOffsetsPerTrigger", max_messages)
              .option("startingOffsets", starting).load())
    return source.select(F.col("value").cast("string").alias("request"),
                         (F.unix_micros("timestamp") * 1000).cast("string").alias("ingestion_ts"))


def parse_messages(messages: DataFrame) -> DataFrame:
    """Requests with ``message_error``: text that is no request, or a bad arrival time.

    A request with a bad arrival time is still handled, as arriving at time 0.
    """
    schema = T.StructType([*REQUEST.fields, T.StructField(_CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    parsed = messages.select("request", "ingestion_ts", F.from_json("request", schema, options).alias("r"),
                             parse_timestamp(F.col("ingestion_ts")).alias("t"))
    broken = F.col("r").isNull() | F.col("r")[_CORRUPT].isNotNull()
    return parsed.select(
        *[F.col("r")[f.name].alias(f.name) for f in REQUEST.fields if f.name != "ingestion_ts"],
        F.coalesce("t.value", F.lit(0)).alias("ingestion_ts"),
        F.when(broken, F.lit("cannot decode request")).otherwise(F.col("t.error")).alias("message_error"),
        broken.alias("undecodable"), F.col("request").alias("raw_request"),
        F.col("ingestion_ts").alias("raw_ingestion_ts"))


def usable_requests(parsed: DataFrame) -> DataFrame:
    return parsed.where(~F.col("undecodable")).select(*REQUEST.fieldNames())


def quarantined_messages(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("message_error").isNotNull()).select(
        F.col("raw_request").alias("request"), F.col("raw_ingestion_ts").alias("ingestion_ts"), "message_error")
