"""Queries over the ingestion log: the events table read as log records."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshledger.catalog.observe import micros, query, table
from meshledger.operators.logs import (
    LogQuery, count_states, filter_log, latest_log, listing_metrics, log_page, log_records, split_rejects,
)
from meshledger.operators.apply import apply_error, explode_apply_errors
from meshledger.functions.scalars import apply_error_text, normalized_error, page_token
from meshledger.plans.query_logs import log_metrics
from meshledger.schemas import APPLY_RESPONSE

STATE_SQL = """CASE event_type WHEN 'click' THEN 'QUEUED' WHEN 'error' THEN 'FAILED'
  WHEN 'view' THEN 'NO_CHANGES' ELSE 'RECONCILED' END"""
TYPE_SQL = """CASE user_id % 3 WHEN 0 THEN 'dcim.site' WHEN 1 THEN 'dcim.device' ELSE 'dcim.interface' END"""
LOG_SQL = f"""WITH log AS (SELECT lpad(CAST(event_id AS VARCHAR), 12, '0') AS id, {STATE_SQL} AS state,
  {TYPE_SQL} AS data_type, 'r' || (event_id // 10) AS request_id, epoch_us(ts) * 1000 AS ingestion_ts,
  event_type AS producer_app_name, json_extract(props, '$.k')::BIGINT AS k FROM events)"""
SHOWN = ("id", "state", "data_type", "request_id", "ingestion_ts", "producer_app_name")
SHOWN_SQL = ", ".join(SHOWN)
START, END = 1704844800000000000, 1705708800000000000  # 2024-01-10 and 2024-01-20


def event_log(spark, folder):
    """The entity text is parsed with the log's own schema, as a scan of stored documents does."""
    kind = F.col("event_type")
    state = F.when(kind == "click", "QUEUED").when(kind == "error", "FAILED").when(
        kind == "view", "NO_CHANGES").otherwise("RECONCILED")
    user = F.col("user_id") % 3
    data_type = F.when(user == 0, "dcim.site").when(user == 1, "dcim.device").otherwise("dcim.interface")
    return table(spark, folder, "events").select(
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("id"), state.alias("state"),
        data_type.alias("data_type"),
        F.concat(F.lit("r"), F.floor(F.col("event_id") / 10).cast("string")).alias("request_id"),
        (micros("ts") * 1000).alias("ingestion_ts"), kind.alias("producer_app_name"),
        F.from_json("props", "k BIGINT")["k"].alias("k"))


def listed(name: str, where: str, log_query: LogQuery) -> None:
    def run(spark, folder):
        return filter_log(event_log(spark, folder), log_query).select(*SHOWN)
    query(name, f"{LOG_SQL} SELECT {SHOWN_SQL} FROM log WHERE {where}")(run)


listed("log_by_time", f"ingestion_ts >= {START} AND ingestion_ts <= {END}",
       LogQuery(ingestion_ts_start=START, ingestion_ts_end=END))
listed("log_open_end", f"ingestion_ts >= {START}", LogQuery(ingestion_ts_start=START))
listed("log_by_state", "state = 'FAILED'", LogQuery(state="FAILED"))
listed("log_by_type", "data_type = 'dcim.device'", LogQuery(data_type="dcim.device"))
listed("log_by_request", "request_id = 'r7'", LogQuery(request_id="r7"))
listed("log_by_producer", "producer_app_name = 'click'", LogQuery(producer_app_name="click"))
listed("log_combined", f"state = 'RECONCILED' AND data_type = 'dcim.site' AND ingestion_ts <= {END}",
       LogQuery(state="RECONCILED", data_type="dcim.site", ingestion_ts_end=END))
listed("log_unfiltered", "true", LogQuery())


@query("log_scan", f"{LOG_SQL} SELECT id, k FROM log")
def log_scan(spark, folder):
    return event_log(spark, folder).select("id", "k")


@query("log_page", f"""{LOG_SQL} SELECT {SHOWN_SQL} FROM log WHERE state = 'RECONCILED'
ORDER BY id DESC LIMIT 25 OFFSET 50""")
def log_page_query(spark, folder):
    """Third page of 25; the token stands for offset 50."""
    return log_page(event_log(spark, folder), LogQuery(
        page_size=25, state="RECONCILED", page_token="AAAAMg==")).select(*SHOWN)


@query("log_deep_page", f"""{LOG_SQL} SELECT {SHOWN_SQL} FROM log WHERE state = 'RECONCILED'
ORDER BY id DESC LIMIT 40 OFFSET (SELECT (count(*) * 3) // 4 FROM log WHERE state = 'RECONCILED')""")
def log_deep_page_query(spark, folder):
    """A page three quarters down the list: ranges of ids are counted, and only those the page lies in are sorted."""
    log = event_log(spark, folder)
    hits = log.where("state = 'RECONCILED'").count() * 3 // 4
    token = spark.range(1).select(page_token(F.lit(hits).cast("bigint"))).first()[0]
    return log_page(log, LogQuery(page_size=40, state="RECONCILED", page_token=token), direct=100, ranges=64).select(*SHOWN)


@query("log_default_page", f"{LOG_SQL} SELECT {SHOWN_SQL} FROM log ORDER BY id DESC LIMIT 100")
def log_default_page(spark, folder):
    """A page size of 1000 and more, and a token that cannot be read, fall back to the defaults."""
    return log_page(event_log(spark, folder), LogQuery(page_size=1000, page_token="x")).select(*SHOWN)


METRICS_SQL = """count(*) AS total, count(*) FILTER (state = 'QUEUED') AS queued,
  count(*) FILTER (state = 'RECONCILED') AS reconciled, count(*) FILTER (state = 'FAILED') AS failed,
  count(*) FILTER (state = 'NO_CHANGES') AS no_changes"""


@query("log_metrics", f"{LOG_SQL} SELECT {METRICS_SQL} FROM log")
def log_metrics_query(spark, folder):
    return log_metrics(event_log(spark, folder))


@query("log_metrics_by_type", f"{LOG_SQL} SELECT data_type, {METRICS_SQL} FROM log GROUP BY data_type")
def log_metrics_by_type(spark, folder):
    return count_states(event_log(spark, folder), "data_type")


@query("log_filtered_total", f"""{LOG_SQL} SELECT 0 AS total, 0 AS queued, 0 AS reconciled,
  count(*) AS failed, 0 AS no_changes FROM log WHERE state = 'FAILED' AND data_type = 'dcim.site'""")
def log_filtered_total(spark, folder):
    return listing_metrics(event_log(spark, folder), LogQuery(state="FAILED", data_type="dcim.site"))


@query("log_latest", f"""
SELECT 'u' || user_id AS id, arg_max({STATE_SQL}, event_id) AS state, max(event_id) AS event_id
FROM events GROUP BY user_id""")
def log_latest(spark, folder):
    """Several writes per id: the last one stands."""
    events = table(spark, folder, "events").select("event_id", "user_id")
    writes = event_log(spark, folder).withColumn("event_id", F.col("id").cast("bigint")).join(events, "event_id")
    writes = writes.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("id"), "state", "event_id")
    return latest_log(writes, "event_id")


@query("log_records", """
SELECT p_partkey, lpad(upper(to_hex(p_partkey)), 16, '0') || '-' || md5('r' || p_partkey)
  || '-0000000000' AS id, 'dcim.devicetype' AS data_type, 'QUEUED' AS state, 'r' || p_partkey AS request_id,
  '{"device_type":{"model":"' || p_name || '"}}' AS entity FROM part""")
def log_records_query(spark, folder):
    from meshledger.catalog.observe import as_requests, entity
    from meshledger.operators.flatten import classify_roots, explode_entities

    rows = as_requests(table(spark, folder, "part"), F.col("p_partkey"),
                       F.array(entity(device_type={"model": F.col("p_name")})))
    return log_records(classify_roots(explode_entities(rows))).select(
        F.col("ingestion_ts").alias("p_partkey"), "id", "data_type", "state", "request_id", "entity")


def responses(spark, folder):
    """Answers of an inventory: events of type error refuse a change set, with up to two errors."""
    k = F.col("event_id")
    text = k.cast("string")
    first = F.create_map(F.lit("change_id"), F.concat(F.lit("c"), text), F.lit("name"), F.concat(F.lit("bad "), text))
    second = F.create_map(F.lit("change_id"), F.concat(F.lit("d"), text), F.lit("slug"), F.lit("taken"))
    refused = F.col("event_type") == "error"
    return table(spark, folder, "events").select(
        F.md5(text).alias("change_set_id"), F.when(refused, 400).otherwise(200).alias("code"),
        F.lit("failed to apply change set").alias("message"), F.when(refused, "failed").otherwise("success").alias("result"),
        F.when(~refused, F.array().cast(APPLY_RESPONSE["errors"].dataType)).when(
            k % 2 == 0, F.array(first)).otherwise(F.array(first, second)).alias("errors"))


@query("apply_errors", """
SELECT md5(CAST(event_id AS VARCHAR)) AS change_set_id, 'c' || event_id AS change_id, 'bad ' || event_id AS error
FROM events WHERE event_type = 'error'
UNION ALL SELECT md5(CAST(event_id AS VARCHAR)), 'd' || event_id, 'taken'
FROM events WHERE event_type = 'error' AND event_id % 2 = 1""")
def apply_errors(spark, folder):
    return explode_apply_errors(responses(spark, folder))


@query("apply_error_text", """
SELECT md5(CAST(event_id AS VARCHAR)) AS change_set_id, 'msg: failed to apply change set, code: 400, change set id: '
  || md5(CAST(event_id AS VARCHAR)) || ', result: failed, errors: [{"change_id":"c' || event_id || '","name":"bad '
  || event_id || '"}' || CASE WHEN event_id % 2 = 1 THEN ',{"change_id":"d' || event_id || '","slug":"taken"}'
  ELSE '' END || ']' AS message FROM events WHERE event_type = 'error'""")
def apply_error_messages(spark, folder):
    rows = responses(spark, folder).where("code >= 400")
    return rows.select("change_set_id", apply_error_text(F.struct("*")).alias("message"))


@query("error_normalisation", """
SELECT event_id, CASE WHEN event_type = 'error' THEN 'failed to apply change set' WHEN event_id % 5 = 0
  THEN 'invalid ingest entity' END AS message,
  CASE WHEN event_type = 'error' THEN 400 WHEN event_id % 5 = 0 THEN 0 END AS code,
  CASE WHEN event_type = 'error' THEN 1 + event_id % 2 ELSE 0 END AS errors FROM events""")
def error_normalisation(spark, folder):
    events = table(spark, folder, "events").withColumn("change_set_id", F.md5(F.col("event_id").cast("string")))
    rows = events.join(apply_error(responses(spark, folder)), "change_set_id", "left")
    plain = F.when(F.col("event_id") % 5 == 0, "invalid ingest entity")
    error = normalized_error(F.col("apply_error"), plain)
    return rows.select("event_id", error.alias("e")).select(
        "event_id", "e.message", "e.code",
        F.greatest(F.lit(0), F.coalesce(F.size("e.details.errors"), F.lit(0))).cast("bigint").alias("errors"))


@query("request_errors", """
SELECT l_orderkey AS orderkey, string_agg('entity at index ' || position || ' is nil', '; ' ORDER BY position) AS errors
FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey,
  l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS position
  FROM lineitem) WHERE l_linenumber % 7 = 0 GROUP BY 1""")
def request_errors_query(spark, folder):
    from meshledger.catalog.ingest import order_requests
    from meshledger.operators.flatten import classify_roots, explode_entities
    from meshledger.operators.logs import request_errors

    found = request_errors(classify_roots(explode_entities(order_requests(spark, folder))))
    return found.select(F.col("ingestion_ts").alias("orderkey"), F.array_join("errors", "; ").alias("errors"))


@query("reject_split", """
SELECT l_orderkey AS orderkey, bool_or(l_linenumber % 7 = 0) AS rejected FROM lineitem GROUP BY 1""")
def reject_split(spark, folder):
    from meshledger.catalog.ingest import order_requests
    from meshledger.operators.flatten import classify_roots, explode_entities
    from meshledger.operators.logs import request_errors

    requests = order_requests(spark, folder)
    good, bad = split_rejects(requests, request_errors(classify_roots(explode_entities(requests))))
    return good.select(F.col("ingestion_ts").alias("orderkey"), F.lit(False).alias("rejected")).unionAll(
        bad.select("ingestion_ts", F.lit(True)))



