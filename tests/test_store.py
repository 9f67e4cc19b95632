"""The state by buckets: what a batch reads and writes, repeats, crashes, old versions; and the log table's pruning."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from meshledger.operators.logs import LogQuery, filter_log
from meshledger.operators.touched import LOOK
from meshledger.plans.reconcile import reconcile
from meshledger.session import stage
from meshledger.sources.log_table import LogTable
from meshledger.sources.state import empty_state
from meshledger.sources.store import BEFORE, FrameState, StateStore, listed
from tests.helpers import many_requests
from tests.test_properties import mixed_requests, state_rows


@pytest.fixture
def store(spark):
    found = StateStore(tempfile.mkdtemp(prefix="meshledger-store-"), buckets=16)
    sites = [(i, f"r{i}", [{"site": {"name": f"S{i}"}}]) for i in range(1, 60)]
    found.begin(spark, reconcile(many_requests(spark, sites), empty_state(spark)).state)
    return found


def change_one(spark, store, batch, comments):
    before = store.snapshot(spark, batch - 1)
    store.commit(before, reconcile(many_requests(spark, [(100 + batch, "c", [{"site": {"name": "S7", "comments": comments}}])]), before).state, batch)
    return before


def test_a_batch_writes_the_bucket_it_touches(spark, store):
    before = change_one(spark, store, 0, "new")
    after = store.snapshot(spark, 0)
    assert len(before.versions) > 8 and set(before.versions.values()) == {BEFORE}
    assert [v for v in after.versions.values() if v == 0] == [0]
    assert len([n for n in listed(spark, store._version(0)) if n.startswith("bucket=")]) == 1
    held = {r.object_key: r.comments for r in after.rows().collect()}
    assert len(held) == 59 and held["S7"] == "new" and held["S8"] is None


def test_a_batch_run_twice_gives_the_same(spark, store):
    change_one(spark, store, 0, "new")
    first, versions = state_rows(store.snapshot(spark, 0).rows()), store.snapshot(spark, 0).versions
    change_one(spark, store, 0, "new")
    assert state_rows(store.snapshot(spark, 0).rows()) == first and store.snapshot(spark, 0).versions == versions


def test_a_killed_batch_leaves_the_old_version(spark, store, monkeypatch):
    change_one(spark, store, 0, "new")
    old = state_rows(store.snapshot(spark, 0).rows())

    def killed(*_):
        raise RuntimeError("killed")

    monkeypatch.setattr("meshledger.sources.store.listed", killed)
    with pytest.raises(RuntimeError):
        change_one(spark, store, 1, "newer")
    monkeypatch.undo()
    assert listed(spark, store._version(1)) and state_rows(store.snapshot(spark, 0).rows()) == old
    with pytest.raises(FileNotFoundError):
        store.snapshot(spark, 1)
    change_one(spark, store, 1, "newer")
    assert {r.comments for r in store.snapshot(spark, 1).rows().collect()} == {None, "newer"}


def test_versions_no_manifest_names_are_deleted(spark, store):
    for batch in range(4):
        change_one(spark, store, batch, f"c{batch}")
    assert [os.path.exists(store.manifest(b)) for b in (BEFORE, 0, 1, 2, 3)] == [False, False, False, True, True]
    alive = {b: [n for n in listed(spark, store._version(b)) if n.startswith("bucket=")] for b in range(4)}
    assert [len(alive[b]) for b in range(4)] == [0, 0, 1, 1]
    assert store.snapshot(spark, 3).rows().count() == 59


def test_a_look_up_reads_the_buckets_of_its_keys(spark, store):
    keys = spark.createDataFrame([("dcim.site", "S7"), ("dcim.site", "none")], f"object_type string, {LOOK} string")
    snapshot = store.snapshot(spark, BEFORE)
    found = snapshot.look_up(keys)
    assert [r.object_key for r in found.collect()] == ["S7"]
    assert 0 < len(found.inputFiles()) <= 2 < len(snapshot.rows().inputFiles())


def test_buckets_equal_one_table(spark):
    """Objects of all types, over two batches, with stored parents that a later batch only finds by a second look-up."""
    rows = mixed_requests(spark, 40)
    table, store = empty_state(spark), StateStore(tempfile.mkdtemp(prefix="meshledger-store-"), buckets=5)
    store.begin(spark, None)
    for number, part in enumerate((rows[:25], rows[25:])):
        before = store.snapshot(spark, number - 1)
        one, two = reconcile(many_requests(spark, part), before), reconcile(many_requests(spark, part), table)
        shown = lambda r: [tuple(x) for x in r.changes.select("seq", "ord", "data").orderBy("seq", "ord").collect()]
        assert shown(one) == shown(two)
        store.commit(before, one.state, number)
        table = stage(two.state)
    assert state_rows(store.snapshot(spark, 1).rows()) == state_rows(table)


def test_the_state_is_looked_up_and_not_scanned_again(spark):
    """However often later steps read the state, its own source is read once for each of the two look-ups a device needs."""
    asked = []

    class Counted(FrameState):
        def look_up(self, keys):
            asked.append(1)
            return super().look_up(keys)

    requests = many_requests(spark, [(1, "a", [{"interface": {"name": "e", "device": {"name": "d", "site": {"name": "s"}}}}])])
    reconcile(requests, Counted(empty_state(spark)))
    assert 1 <= len(asked) <= 2


def test_a_time_filter_reads_its_days(spark):
    day = 86_400_000_000_000
    rows = spark.range(100).select(F.col("id").cast("string").alias("id"), (F.col("id") % 10 * day + 5).alias("ingestion_ts"), F.lit("QUEUED").alias("state"))
    log = LogTable(tempfile.mkdtemp(prefix="meshledger-log-"))
    log.write(rows, 0)
    log.write(rows.withColumn("state", F.lit("FAILED")), 0)
    log.write(rows.withColumn("id", F.concat(F.lit("x"), "id")), 1)
    everything = log.read(spark)
    assert everything.count() == 200 and everything.where("state = 'FAILED'").count() == 100
    found = filter_log(everything, LogQuery(ingestion_ts_start=3 * day, ingestion_ts_end=4 * day + 9))
    assert found.count() == 40
    assert "PartitionFilters: [isnotnull(day" in found._jdf.queryExecution().toString()


def test_heavy_keys_get_salts_by_their_rows(spark):
    from meshledger.operators.salts import heavy_keys, join_salted

    rows = stage(spark.range(1000).select(F.col("id").alias("seq"), F.when(F.col("id") < 900, "hot").when(
        F.col("id") < 990, F.concat(F.lit("k"), (F.col("id") % 9).cast("string"))).alias("name")))
    side = spark.createDataFrame([("hot", 1), ("k3", 2), ("else", 3)], "name string, v int")
    assert heavy_keys(rows, ["name"], 1000) is None and heavy_keys(rows, ["name"], None) is None
    heavy = heavy_keys(rows, ["name"], 100)
    assert [tuple(r) for r in heavy.collect()] == [("hot", 9)]
    salted, plain = join_salted(rows, side, ["name"], heavy, "seq"), rows.join(side, ["name"], "left")
    assert sorted(salted.select("seq", "v").collect(), key=str) == sorted(plain.select("seq", "v").collect(), key=str)
