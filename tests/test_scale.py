"""Steps whose memory or time must not follow the largest table or key."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from meshledger.catalog.parents import late_platforms
from meshledger.operators import salts, steady
from meshledger.operators.fold import fold_observations, state_of_batch
from meshledger.operators.logs import log_records
from meshledger.operators.resolve import apply_resolution
from meshledger.plans.constraints import check_constraints
from meshledger.plans import reconcile as plan
from meshledger.plans.reconcile import keyed_roots, reconcile
from meshledger.operators.flatten import classify_roots, explode_entities, flatten, narrowed, number_copies, present_kinds
from meshledger.operators.steady import split_steady
from meshledger.operators.touched import named_keys
from meshledger.registry import shape_of
from meshledger.session import DROP_SHUFFLES, ensure_checkpoint_dir, stage
from meshledger.sources.state import empty_state
from meshledger.sources.store import FrameState
from meshledger.streaming.job import count_states_of_stream, state_totals, stream_state_changes
from tests.helpers import many_requests


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_found_parents_do_not_pass_through_the_driver(spark, monkeypatch):
    """there may be a found parent for every root."""
    monkeypatch.setattr(salts, "BROADCAST_KEYS", 3)
    entities = [{"device": {"name": f"d{i}", "site": {"name": "hall"}}} for i in range(5)]
    keyed = stage(keyed_roots(classify_roots(explode_entities(many_requests(spark, [(1, "r1", entities)])))))
    found = keyed.select("seq", F.lit("x").alias("new_role"))
    done = apply_resolution(keyed, found)
    assert "Broadcast" not in plan_of(done)
    assert done.where("key_role = 'x'").count() == 5


def test_running_counts_call_no_python_by_id(spark, tmp_path):
    """a call by id took most of the time. Four batches: late, repeated and contradicting records count nothing."""
    assert "InPandas" not in stream_state_changes(
        spark.readStream.schema("id string, state string").parquet(str(tmp_path)))._jdf.queryExecution().analyzed().toString()
    parts = [[("a", "QUEUED"), ("b", "FAILED"), ("z", "OTHER")], [("a", "QUEUED"), ("b", "QUEUED"), ("c", "QUEUED"), ("c", "FAILED")],
             [("a", "FAILED"), ("b", "RECONCILED"), ("d", "QUEUED")], [("a", "NO_CHANGES"), ("d", "QUEUED"), ("c", "QUEUED")]]
    totals = []
    for part in parts:
        spark.createDataFrame(part, "id string, state string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
        source = spark.readStream.schema("id string, state string").parquet(f"{tmp_path}/log")
        count_states_of_stream(source, f"{tmp_path}/counts", f"{tmp_path}/checkpoint").awaitTermination()
        totals.append(tuple(state_totals(spark.read.parquet(f"{tmp_path}/counts")).first()))
    # total, queued, reconciled, failed, no changes
    assert totals == [(2, 1, 0, 1, 0), (3, 1, 0, 2, 0), (4, 1, 0, 3, 0), (4, 1, 0, 3, 0)]


def test_a_key_of_many_roots_is_folded_in_chunks(spark, monkeypatch):
    """all observations of a role were sorted by one task."""
    from meshledger.catalog import state

    monkeypatch.setattr(state, "HOT_ROWS", 100)
    folder = "/root/testdata/sf0.001"
    done = state.first_creator(spark, folder)
    assert "_chunk" in plan_of(done) and "_start_" in plan_of(done)
    want = spark.read.parquet(f"{folder}/orders.parquet").groupBy("o_orderpriority").agg(F.min("o_orderkey"))
    assert sorted(map(tuple, done.collect())) == sorted(map(tuple, want.collect()))


def test_entities_of_one_split_are_checked_by_several_tasks(spark):
    """a small file was read, and all of its entities checked, by one task."""
    entities = [{"site": {"name": f"s{i}", "status": "lost"}} for i in range(40)]
    one = stage(many_requests(spark, [(1, "r1", entities)]).coalesce(1))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = check_constraints(one).where("violation = 'site.status: in'").withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(r.position for r in found) == list(range(40))
    assert len({r.task for r in found}) > 1


def test_tasks_of_large_tables_follow_their_rows(spark, monkeypatch):
    """the rows of a task grew with the batch, whatever their number. Repeated requests are numbered all the same."""
    monkeypatch.setattr(salts, "TASK_ROWS", 4)
    again = many_requests(spark, [(i, f"r{i}", [{"site": {"name": f"s{i}"}}]) for i in range(30) for _ in range(2)])
    numbered = number_copies(again)
    assert "REPARTITION_BY_NUM" in plan_of(numbered)
    assert sorted((r.id, r.copy) for r in numbered.collect()) == sorted((f"r{i}", n) for i in range(30) for n in range(2))
    result = reconcile(again, empty_state(spark))
    assert "REPARTITION_BY_NUM" in plan_of(result.log)
    assert sorted(r.state for r in result.log.collect()) == ["NO_CHANGES"] * 30 + ["RECONCILED"] * 30
    assert result.changes.count() == 30


def shuffle_files(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return sum(blocks.apply(i).isShuffle() for i in range(blocks.length()))


def staged_folders(spark):
    ensure_checkpoint_dir(spark)
    folder = spark.sparkContext.getCheckpointDir()
    return {f for f in os.listdir(folder.removeprefix("file:")) if f.startswith("staged-")}


def test_staged_tables_leave_no_shuffle_files(spark):
    """the files of every shuffle stayed until the driver happened to collect its garbage."""
    before = shuffle_files(spark)
    staged = stage(spark.range(1000).repartition(4, "id").groupBy((F.col("id") % 7).alias("k")).count())
    assert shuffle_files(spark) == before
    assert staged.count() == 7 and spark.conf.get(DROP_SHUFFLES, "false") == "false"


def test_a_job_keeps_no_tables_of_its_steps(spark):
    """nodes, look-ups, keys and the rounds' tables stayed. The roots and the changes are read by what the job returns."""
    again = many_requests(spark, [(i, f"r{i}", [{"interface": {"name": "e", "device": {"name": f"d{i % 3}", "platform": {"name": "p"},
                                                 "site": {"name": "hall"}}}}]) for i in range(6)])
    before = staged_folders(spark)
    result = reconcile(again, empty_state(spark))
    assert result.changes.count() and result.log.count() == 6
    kept = sorted(f for f in staged_folders(spark) - before)
    assert len(kept) <= 3  # roots, changes, and the list of repeated requests


def test_nodes_of_types_without_steady_keys_are_not_shuffled(spark):
    """all nodes were shuffled twice to meet a few keys."""
    shape = shape_of(["dcim.interface"])
    entities = [{"interface": {"name": f"e{i}", "device": {"name": f"d{i}", "site": {"name": "hall"}}}} for i in range(5)]
    keyed = stage(keyed_roots(classify_roots(explode_entities(many_requests(spark, [(1, "r1", entities)]))), shape))
    nodes = stage(flatten(apply_resolution(keyed, None, shape), shape=shape))
    moving, quiet = split_steady(nodes, empty_state(spark), shape, 1)
    assert "Exchange hashpartitioning" not in plan_of(moving) and "Exchange hashpartitioning" not in plan_of(quiet)
    assert sorted(r.slot for r in quiet.collect()) == sorted(["site", "manufacturer", "role", "device_type"] * 4)
    assert moving.count() + quiet.count() == nodes.count() == 30


def test_rows_that_share_a_chunk_are_shuffled_once(spark, monkeypatch):
    """the fold's rows were dealt by key and chunk, then shuffled by key as all had one chunk."""
    monkeypatch.setattr(salts, "TASK_ROWS", 2)
    entities = [{"site": {"name": f"s{i % 4}", "description": f"d{i}"}} for i in range(8)]
    shape = shape_of(["dcim.site"])
    keyed = stage(keyed_roots(classify_roots(explode_entities(many_requests(spark, [(1, "r1", entities)]))), shape))
    nodes = stage(flatten(apply_resolution(keyed, None, shape), shape=shape))
    folded = fold_observations(nodes, empty_state(spark), shape=shape, number=nodes.count())
    window = plan_of(folded).split("Window")[-1]
    assert window.index("REPARTITION_BY_NUM") < (window + "ENSURE_REQUIREMENTS").index("ENSURE_REQUIREMENTS")
    assert folded.where("created").count() == 4


def test_sides_that_grow_with_the_batch_do_not_pass_through_the_driver(spark, monkeypatch):
    """few columns of a wide table are estimated as small, so keys, counts and copies were broadcast, however many they were."""
    for module in (salts, steady):
        monkeypatch.setattr(module, "BROADCAST_KEYS", 3)
    again = many_requests(spark, [(i, f"r{i}", [{"site": {"name": f"s{i}"}}]) for i in range(8) for _ in range(2)])
    numbered = number_copies(again)
    assert "Broadcast" not in plan_of(numbered) and numbered.count() == 16
    shape, state = shape_of(["dcim.site"]), empty_state(spark)
    keyed = stage(keyed_roots(classify_roots(explode_entities(numbered)), shape))
    assert "Broadcast" not in plan_of(FrameState(state).look_up(stage(named_keys(keyed, shape))))
    nodes = stage(flatten(apply_resolution(keyed, None, shape), shape=shape))
    moving, quiet = split_steady(nodes, state, shape)
    assert "Broadcast" not in plan_of(moving) and "Broadcast" not in plan_of(quiet)
    assert moving.count() == quiet.count() == 8
    assert "Broadcast" not in plan_of(state_of_batch(state, nodes, nodes.count()))
    assert "Broadcast" not in plan_of(reconcile(again, state).log)


def test_late_parents_are_made_by_several_tasks(spark):
    """all requests of a small file were made by one task, twice, and of five entities for every four."""
    folder = "/root/testdata/sf0.001"
    rows = late_platforms(spark, folder).withColumn("task", F.spark_partition_id()).withColumn("d", F.col("entities")[0]["device"]).collect()
    assert len({r.task for r in rows}) > 1
    number = spark.read.parquet(f"{folder}/customer.parquet").count()
    assert sorted(r.ingestion_ts for r in rows) == list(range(4 * number))
    for r in rows:
        k, step = divmod(r.ingestion_ts, 4)
        platform = {0: None, 1: "ios", 2: None if k % 3 == 2 else "eos", 3: "ios"}[step]
        assert (r.d.platform and r.d.platform.name) == platform
        assert r.d.serial == (f"S{k}" if step == 2 and k % 3 else None)


def test_kinds_that_do_not_occur_are_left_out(spark):
    """hundreds of null columns were written, read and laid out. The keys and the objects are the same without them."""
    entities = [{"device": {"name": "d", "site": {"name": "hall"}, "platform": {"name": "p", "manufacturer": {"name": "m"}}}},
                {"interface": {"name": "e", "device": {"name": "d"}}}, {"site": {"name": "hall"}}, {"interface": {"name": ""}}, {}]
    requests = many_requests(spark, [(1, "r1", entities), (2, "r2", entities[:1])])
    kinds = present_kinds(requests)
    assert set(kinds) == {"site", "device", "interface"}
    narrow = requests.withColumn("entities", F.transform("entities", lambda e: narrowed(e, kinds)))
    assert set(narrow.schema["entities"].dataType.elementType.fieldNames()) == {*kinds, "timestamp"}
    roots = [classify_roots(explode_entities(r)) for r in (requests, narrow)]
    for columns in (["seq", "object_type", "root_error"], ["seq", "entity"]):
        wide, less = [sorted((log_records(r) if "entity" in columns else r).select(*columns).collect(), key=lambda r: r.seq) for r in roots]
        assert wide == less and len(wide) >= 5
    shape = shape_of(["dcim.interface", "dcim.device", "dcim.site"])
    wide, less = [sorted(map(str, keyed_roots(r, shape).collect())) for r in roots]
    assert wide == less and len(wide) == 4


def test_slices_of_a_batch_decide_the_same(spark, monkeypatch):
    """the shuffle by root held all nodes of a batch at once."""
    again = many_requests(spark, [(i, f"r{i}", [{"device": {"name": f"d{i % 3}", "serial": f"s{i % 4}", "tags": [{"name": f"t{i % 2}"}],
                                                            "platform": {"name": "p"}, "site": {"name": "hall"}}}]) for i in range(12)])
    whole = sorted(map(str, reconcile(again, empty_state(spark)).changes.collect()))
    monkeypatch.setattr(plan, "SLICED_NODES", 5)
    parts = []
    monkeypatch.setattr(plan, "stage", lambda *frames: parts.append(len(frames)) or stage(*frames))
    sliced = reconcile(again, empty_state(spark)).changes
    assert sorted(map(str, sliced.collect())) == whole and len(whole) > 12
    assert max(parts) == plan.SLICES
