"""Streaming queries: given rows land as messages, the job runs over them to its end, its tables are the result.

Every part lands with the job stopped and is one batch of the next run, as with a job that a scheduler starts. Landing folder,
checkpoint and tables lie in the shared folder of the session.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshledger.catalog.jobs import SITES_SQL, observed_sites, stored_sites
from meshledger.catalog.logs import END, LOG_SQL, METRICS_SQL, START, event_log
from meshledger.catalog.observe import arrival, as_requests, entity, micros, query, table
from meshledger.functions.scalars import assigned_id
from meshledger.operators.logs import LogQuery, filter_log
from meshledger.plans.reconcile import reconcile
from meshledger.session import ensure_checkpoint_dir
from meshledger.sources.log_table import LogTable, from_documents, to_documents
from meshledger.sources.requests import stream_messages
from meshledger.sources.state import empty_state
from meshledger.sources.store import BEFORE, StateStore
from meshledger.streaming.job import Paths, count_states_of_stream, reconcile_stream, state_totals

#: Files of a part that one batch takes; a part is never more.
FILES = 100_000


def shared_folder(spark: SparkSession, name: str) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def messages(requests: DataFrame) -> DataFrame:
    body = F.to_json(F.struct(*[c for c in requests.columns if c != "ingestion_ts"]))
    return requests.select(body.alias("request"), F.col("ingestion_ts").cast("string").alias("ingestion_ts"))


def streamed(spark: SparkSession, parts: list[DataFrame], initial: DataFrame | None = None) -> tuple[Paths, int]:
    """Run the job over the parts (request, ingestion_ts), one batch each; its folders, and the last batch's number."""
    root = shared_folder(spark, "stream")
    done: list[int] = []
    for part in parts:
        part.write.mode("append").parquet(f"{root}/landing")
        running = reconcile_stream(stream_messages(spark, f"{root}/landing", max_files=FILES), f"{root}/job", f"{root}/checkpoint",
                                   initial=initial, on_batch=done.append)
        running.awaitTermination()
        if running.exception() is not None:
            raise running.exception()
    return Paths(f"{root}/job"), max(done, default=BEFORE)


def halves(rows: DataFrame, key: str = "ingestion_ts") -> list[DataFrame]:
    """The rows in two parts, one after the other in arrival order."""
    middle = rows.agg(F.avg(key)).first()[0]
    return [rows.where(F.col(key) <= F.lit(middle or 0)), rows.where(F.col(key) > F.lit(middle or 0))]


@query("stream_sites", SITES_SQL + """
SELECT k AS s_suppkey, change_type, 'dcim.site' AS object_type,
  CASE WHEN change_type = 'update' AND stored THEN nk + 1 END AS stored_id, name, lower(replace(name, ' ', '-')) AS slug,
  coalesce(new_status, 'active') AS status, new_descr AS description FROM f WHERE change_type IS NOT NULL""")
def stream_sites(spark, folder):
    """The changes of ``reconcile_sites``, from a stream of two batches."""
    parts = [messages(p) for p in halves(observed_sites(spark, folder))]
    paths, _ = streamed(spark, parts, stored_sites(spark, folder))
    changes = spark.read.parquet(paths.all("changes"))
    data = F.from_json("data", "name STRING, slug STRING, status STRING, description STRING")
    return changes.select(
        arrival().alias("s_suppkey"), "change_type", "object_type",
        F.when(F.col("object_id") != assigned_id(F.col("object_type"), F.col("object_key")), F.col("object_id")).alias("stored_id"),
        data.alias("d")).select("s_suppkey", "change_type", "object_type", "stored_id", "d.*")


@query("stream_poison", """
SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN 'cannot decode request'
  ELSE 'failed to convert ingestion timestamp: soon' END AS message_error,
  CASE WHEN s_suppkey % 7 != 0 THEN 'RECONCILED' END AS state
FROM supplier WHERE s_suppkey % 7 = 0 OR s_suppkey % 5 = 0""")
def stream_poison(spark, folder):
    """Messages that are no requests go to quarantine; those without a time do so too, and are handled as of time 0."""
    k = F.col("s_suppkey")
    rows = table(spark, folder, "supplier")
    good = messages(as_requests(rows, k, F.array(entity(site={"name": F.col("s_name")})), "s_suppkey").drop("s_suppkey"))
    number = F.regexp_extract("request", '"id":"r([0-9]+)"', 1).cast("bigint")
    bad = good.select(F.when(number % 7 == 0, F.concat(F.lit("{broken r"), number.cast("string"))).otherwise(F.col("request")).alias("request"),
                      F.when((number % 7 != 0) & (number % 5 == 0), "soon").otherwise(F.col("ingestion_ts")).alias("ingestion_ts"))
    paths, _ = streamed(spark, [bad])
    kept = spark.read.parquet(paths.all("quarantine")).select(
        F.regexp_extract("request", "(?:broken |\"id\":\")r([0-9]+)", 1).cast("bigint").alias("s_suppkey"), "message_error")
    log = LogTable(paths.all("log")).read(spark).select(F.substring("request_id", 2, 20).cast("bigint").alias("s_suppkey"), "state")
    return kept.join(log, "s_suppkey", "left")


@query("stream_repeat", """
SELECT s_suppkey, state, 1 AS n, 2 AS ids FROM supplier, (VALUES ('RECONCILED'), ('NO_CHANGES')) AS t(state)""")
def stream_repeat(spark, folder):
    """Every message is delivered in two batches: the second delivery is a record of its own and finds nothing to change."""
    rows = messages(as_requests(table(spark, folder, "supplier"), F.col("s_suppkey"), F.array(entity(site={"name": F.col("s_name")}))))
    paths, _ = streamed(spark, [rows, rows])
    log = LogTable(paths.all("log")).read(spark)
    ids = log.groupBy("request_id").agg(F.countDistinct("id").alias("ids"))
    counts = log.groupBy("request_id", "state").agg(F.count("*").alias("n")).join(ids, "request_id")
    return counts.select(F.substring("request_id", 2, 20).cast("bigint").alias("s_suppkey"), "state", "n", "ids")


@query("state_after_batches", SITES_SQL + """
, fin AS (SELECT nk, arg_max(coalesce(new_status, 'active'), k) AS status, arg_max(new_descr, k) AS d FROM r GROUP BY 1)
SELECT n_name AS name, coalesce(fin.status, 'active') AS status, coalesce(fin.d, '-') AS description
FROM nation LEFT JOIN fin ON nk = n_nationkey WHERE n_nationkey % 7 != 0 OR nk IS NOT NULL""")
def state_after_batches(spark, folder):
    """The state by buckets after two batches that each write the buckets they touch."""
    store = StateStore(shared_folder(spark, "store"))
    store.begin(spark, stored_sites(spark, folder))
    for number, part in enumerate(halves(observed_sites(spark, folder))):
        before = store.snapshot(spark, number - 1)
        store.commit(before, reconcile(part, before).state, number)
    return store.snapshot(spark, 1).rows().select(F.col("object_key").alias("name"), "status",
                                                  F.coalesce("description", F.lit("-")).alias("description"))


@query("log_documents", """
SELECT s_suppkey, CASE WHEN s_suppkey % 11 = 0 THEN 'FAILED' ELSE 'RECONCILED' END AS state,
  CASE WHEN s_suppkey % 11 != 0 THEN 'dcim.site' END AS changed, CASE WHEN s_suppkey % 11 != 0 THEN s_name END AS name,
  'ingest-entity:dcim.site-' || s_suppkey || '-' AS key_start, CASE WHEN s_suppkey % 11 = 0 THEN 0 END AS code FROM supplier""")
def log_documents(spark, folder):
    """The log of a job as documents under their keys, and read back with the whole schema."""
    from meshledger.operators.logs import with_change_sets

    k = F.col("s_suppkey")
    seen = entity(site={"name": F.when(k % 11 == 0, "").otherwise(F.col("s_name"))})
    result = reconcile(as_requests(table(spark, folder, "supplier"), k, F.array(seen)), empty_state(spark))
    documents = to_documents(with_change_sets(result.log, result.change_sets))
    back = from_documents(documents.select("log_key", "document"))
    keys = documents.select("log_key", F.get_json_object("document", "$.id").alias("id"))
    return back.join(keys, "id").select(
        F.col("ingestion_ts").alias("s_suppkey"), "state", F.col("change_set")[0]["object_type"].alias("changed"),
        F.get_json_object(F.col("change_set")[0]["data"], "$.name").alias("name"),
        F.expr("left(log_key, length(log_key) - length(id))").alias("key_start"), F.col("error.code").alias("code"))


@query("log_pruned", f"""
SELECT event_id, epoch_us(ts) * 1000 AS ingestion_ts FROM events
WHERE epoch_us(ts) * 1000 BETWEEN {START} AND {END} AND event_type = 'click'""")
def log_pruned(spark, folder):
    """A log table written by day in two batches; a time filter reads the days it covers."""
    records = table(spark, folder, "events").select(
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("id"), F.lit("RECONCILED").alias("state"),
        (micros("ts") * 1000).alias("ingestion_ts"), F.col("event_type").alias("producer_app_name"))
    log = LogTable(shared_folder(spark, "log"))
    for number, part in enumerate(halves(records)):
        log.write(part.withColumn("state", F.lit("QUEUED")), number)
        log.write(part, number)
    wanted = LogQuery(ingestion_ts_start=START, ingestion_ts_end=END, producer_app_name="click", state="RECONCILED")
    return filter_log(log.read(spark), wanted).select(F.col("id").cast("bigint").alias("event_id"), "ingestion_ts")


@query("stream_state_counts", f"{LOG_SQL} SELECT {METRICS_SQL} FROM log")
def stream_state_counts(spark, folder):
    """Counts that run along with the log: every event is queued first; its own record, in the next batch, corrects them."""
    log = event_log(spark, folder).select("id", "state")
    root = shared_folder(spark, "counts")
    for part in (log.withColumn("state", F.lit("QUEUED")), log):
        part.write.mode("append").parquet(f"{root}/log")
        source = spark.readStream.schema("id string, state string").option("maxFilesPerTrigger", FILES).parquet(f"{root}/log")
        running = count_states_of_stream(source, f"{root}/counts", f"{root}/checkpoint")
        running.awaitTermination()
        if running.exception() is not None:
            raise running.exception()
    return state_totals(spark.read.parquet(f"{root}/counts"))
