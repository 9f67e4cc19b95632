"""Properties: chunks change nothing, a second run finds nothing, a stream ends where a batch does."""

import json
import tempfile

from pyspark.sql import functions as F

from meshledger.operators.carry import add_chunks, carry_forward
from meshledger.functions.scalars import page_token
from meshledger.operators.logs import LogQuery, log_page
from meshledger.plans.query_logs import log_metrics, query_logs
from meshledger.plans.reconcile import reconcile
from meshledger.session import stage
from meshledger.sources.log_table import LogTable
from meshledger.sources.state import empty_state
from meshledger.sources.store import StateStore
from meshledger.streaming.job import Paths, count_states_of_stream, reconcile_stream, state_totals
from tests.helpers import many_requests


def test_carry_forward_in_chunks_equals_brute_force(spark):
    rows = [(k, t, None if (t * 7 + len(k)) % 3 == 0 else t * 10, None if t % 4 else f"s{t}")
            for k in ("hot", "b", "cc") for t in range(60 if k == "hot" else 4)]
    frame = spark.createDataFrame(rows, "k string, t int, v int, s string").withColumn(
        "order", F.lpad(F.col("t").cast("string"), 4, "0"))
    got = {}
    for limit in (None, 5):
        cut, chunked = add_chunks(frame, ["k"], "order", limit, chunks=7)
        assert chunked == (limit is not None)
        if chunked:
            assert cut.where("k = 'hot'").select("_chunk").distinct().count() > 4
        done = carry_forward(cut, ["k"], ["order"], ["v"], ["s"], chunked)
        got[limit] = {(r["k"], r["t"]): (r["before_v"], r["before_s"]) for r in done.collect()}
    want = {}
    for k, t, _, _ in rows:
        earlier = [r for r in rows if r[0] == k and r[1] < t]
        values = [r[2] for r in earlier if r[2] is not None]
        texts = [r[3] for r in earlier if r[3] is not None]
        want[(k, t)] = (values[-1] if values else None, texts[0] if texts else None)
    assert got[None] == want and got[5] == want


def mixed_requests(spark, n=90):
    """Repeated, incomplete observations that meet on few keys, most of them on the placeholders."""
    rows = []
    for i in range(n):
        kind = i % 6
        site = {"name": f"S{i % 4}", "facility": f"F{i % 3}"} if i % 5 else None
        tags = [{"name": f"t{i % 7}"}, {"name": f"u{i % 3}"}] if i % 4 == 0 else None
        machine = {"name": f"vm{i % 3}", "site": site, "memory": i % 8}
        if i % 7 == 0:
            machine["cluster"] = {"name": "" if i % 2 else "cl", "group": {"name": f"g{i % 2}"}}
        entity = [
            {"site": {**(site or {"name": "undefined"}), "tags": tags}},
            {"device": {"name": f"d{i % 3}", "site": site, "serial": str(i % 9), "tags": tags,
                        "role": {"name": f"r{i % 2}"} if i % 2 else None}},
            {"interface": {"name": f"if{i % 2}", "label": f"l{i % 4}" if i % 3 else None,
                           "device": {"name": f"d{i % 3}", "site": site, "platform": {"name": "p"}}}},
            {"virtual_machine": machine},
            {"prefix": {"prefix": f"10.{i % 2}.0.0/16", "site": site, "description": f"x{i % 5}"}},
            {"ip_address": {"address": f"10.0.0.{i % 3}", "interface": {"name": "eth"} if i % 2 else None}},
        ][kind]
        rows.append((i + 1, f"r{i}", [entity]))
    return rows


def change_list(result):
    return [(r["seq"], r["ord"], r["change_type"], r["object_type"], r["data"])
            for r in result.changes.orderBy("seq", "ord").collect()]


def state_rows(state):
    return sorted(json.dumps(r.asDict(recursive=True), sort_keys=True, default=str) for r in state.collect())


def test_hot_keys_and_second_run(spark):
    requests = stage(many_requests(spark, mixed_requests(spark)))
    plain = reconcile(requests, empty_state(spark), hot_rows=None)
    chunked = reconcile(requests, empty_state(spark), hot_rows=4)
    changes = change_list(plain)
    assert len(changes) > 90 and change_list(chunked) == changes
    state = stage(plain.state)
    # The final observations alone are what the state holds: nothing is new.
    last = [r for r in mixed_requests(spark) if r[2][0].get("device")][-1:]
    again = reconcile(many_requests(spark, [(1000, "again", last[0][2])]), state, hot_rows=None)
    first = change_list(again)
    third = reconcile(many_requests(spark, [(1001, "third", last[0][2])]), stage(again.state), hot_rows=None)
    assert change_list(third) == [] and len(first) <= 2


def test_stream_ends_where_the_batch_does(spark):
    rows = mixed_requests(spark, 30)
    landing, root, checkpoint = (tempfile.mkdtemp(prefix=f"meshledger-{n}-") for n in ("in", "out", "cp"))
    everything = many_requests(spark, rows)
    for part in range(2):
        chunk = everything.where(F.floor((F.col("ingestion_ts") - 1) / 15) == part)
        body = F.to_json(F.struct(*[c for c in chunk.columns if c != "ingestion_ts"]))
        messages = chunk.select(body.alias("request"), F.col("ingestion_ts").cast("string").alias("ingestion_ts"))
        if part == 1:
            messages = messages.unionByName(spark.createDataFrame([("{broken", "5")], "request string, ingestion_ts string"))
        messages.coalesce(1).write.mode("append").parquet(landing)
    from meshledger.sources.requests import stream_messages

    query = reconcile_stream(stream_messages(spark, landing, max_files=1), root, checkpoint, hot_rows=None)
    query.awaitTermination(600)
    assert query.exception() is None
    paths = Paths(root)
    log = LogTable(paths.all("log")).read(spark)
    assert log.select("batch").distinct().count() == 2
    final = StateStore(root).snapshot(spark, 1).rows()
    batch = reconcile(everything, empty_state(spark), hot_rows=None)
    assert state_rows(final) == state_rows(batch.state)
    assert [r["message_error"] for r in spark.read.parquet(paths.all("quarantine")).collect()] == ["cannot decode request"]
    assert log.count() == 30 and log.where("state = 'QUEUED'").isEmpty()
    assert log.where("(state = 'RECONCILED') != (size(change_set) > 0)").isEmpty()

    page = query_logs(log, LogQuery(page_size=20))
    assert page.logs.count() == 20 and page.next_page_token == "AAAAFA=="
    assert page.metrics.first()["total"] == 30
    rest = query_logs(log, LogQuery(page_size=20, page_token=page.next_page_token))
    assert rest.logs.count() == 10 and rest.next_page_token == ""

    source = spark.readStream.schema(log.schema).parquet(paths.all("log"))
    count_states_of_stream(source, f"{root}/counts", f"{root}/counting").awaitTermination()
    assert state_totals(spark.read.parquet(f"{root}/counts")).collect() == log_metrics(log).collect()


def test_running_counts_are_corrected(spark):
    """Queued before, with, after and without the final record; a final record that comes twice."""
    landing, root = (tempfile.mkdtemp(prefix=f"meshledger-{n}-") for n in ("in", "out"))
    parts = [[("a", "QUEUED"), ("b", "QUEUED"), ("c", "FAILED")], [("a", "RECONCILED"), ("d", "QUEUED"), ("d", "NO_CHANGES")],
             [("c", "QUEUED"), ("a", "RECONCILED"), ("e", "RECONCILED"), ("f", "QUEUED")]]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, "id string, state string").coalesce(1).write.mode("append").parquet(landing)
        source = spark.readStream.schema("id string, state string").parquet(landing)
        count_states_of_stream(source, f"{root}/counts", f"{root}/checkpoint").awaitTermination()
    got = state_totals(spark.read.parquet(f"{root}/counts")).first().asDict()
    assert got == {"total": 6, "queued": 2, "reconciled": 2, "failed": 1, "no_changes": 1}


def test_deep_pages_equal_shallow_ones(spark):
    log = spark.range(500).select(F.lpad((F.col("id") * 7919 % 1000).cast("string"), 5, "0").alias("id"), F.lit("FAILED").alias("state"))
    for offset in (0, 1, 99, 250, 490, 499, 500, 9999):
        query = LogQuery(page_size=20, page_token=spark.range(1).select(page_token(F.lit(offset).cast("bigint"))).first()[0])
        plain = [r.id for r in log_page(log, query).collect()]
        assert [r.id for r in log_page(log, query, direct=-1, ranges=16).collect()] == plain
        assert len(plain) == max(0, min(20, 500 - offset))


def test_steady_keys_change_nothing(spark):
    """Folding every node gives the same changes as folding only those that can matter."""
    from meshledger.operators.changes import decide
    from meshledger.operators.flatten import classify_roots, explode_entities, flatten
    from meshledger.operators.fold import fold_observations
    from meshledger.operators.resolve import apply_resolution, resolve_parents
    from meshledger.operators.steady import split_steady
    from meshledger.operators.tags import attached_tags
    from meshledger.plans.reconcile import keyed_roots

    state = empty_state(spark)
    roots = classify_roots(explode_entities(many_requests(spark, mixed_requests(spark, 60))))
    keyed = stage(keyed_roots(roots))
    nodes = stage(flatten(apply_resolution(keyed, resolve_parents(keyed, state))))
    moving, quiet = split_steady(nodes, state)
    moving, quiet = stage(moving), stage(quiet)
    assert quiet.count() > 0 and moving.count() + quiet.count() == nodes.count()

    attached = attached_tags(nodes, state, state, None)

    def listed(folded):
        rows = decide(folded, attached).orderBy("seq", "ord").collect()
        return [(r["seq"], r["ord"], r["change_type"], r["object_type"], r["data"]) for r in rows]

    part = fold_observations(moving, state, attached=attached).unionByName(quiet, allowMissingColumns=True)
    assert listed(part) == listed(fold_observations(nodes, state, attached=attached))
