"""Small builders: requests from dicts, stored objects from (type, look-up key, object)."""

import json

from pyspark.sql import functions as F

from meshledger.plans.reconcile import reconcile
from meshledger.registry import SEPARATOR
from meshledger.schemas import REQUEST
from meshledger.session import stage
from meshledger.sources.state import empty_state, wrap_state

UNDEFINED = {"name": "undefined", "slug": "undefined"}


def requests(spark, entities, ts=1, request_id="r1"):
    return many_requests(spark, [(ts, request_id, entities)])


def many_requests(spark, rows):
    body = [json.dumps({
        "stream": "latest", "id": rid, "producer_app_name": "agent", "producer_app_version": "1.0.0",
        "sdk_name": "sdk", "sdk_version": "1.0.0", "ingestion_ts": ts, "entities": entities,
    }) for ts, rid, entities in rows]
    frame = spark.createDataFrame([(b,) for b in body], "body string")
    return frame.select(F.from_json("body", REQUEST).alias("r")).select("r.*")


def key(*parts):
    return SEPARATOR.join(parts)


def stored(spark, objects):
    """objects: (object_type, look-up key, object)."""
    if not objects:
        return empty_state(spark)
    rows = [(t, o.get("id"), json.dumps(o), k) for t, k, o in objects]
    frame = spark.createDataFrame(rows, "object_type string, object_id bigint, object string, lookup_key string")
    return stage(wrap_state(frame, tuple(sorted({t for t, _, _ in objects}))))


def run(spark, entities, objects=(), **options):
    return reconcile(requests(spark, entities), stored(spark, list(objects)), **options)


def changes_by_position(result):
    """Changes of every entity of a single request, in order: position -> [(type, object type, data)]."""
    found = {}
    for r in result.changes.orderBy("seq", "ord").collect():
        found.setdefault(int(r["seq"][-10:]), []).append((r["change_type"], r["object_type"], json.loads(r["data"])))
    return found


def changes_of(result):
    return [c for _, cs in sorted(changes_by_position(result).items()) for c in cs]
