"""Repeats, refusals and values that move, and slugs of other scripts."""

import tempfile

import pytest
from pyspark.sql import functions as F

from meshledger.functions.scalars import slugify
from meshledger.plans.reconcile import reconcile
from meshledger.schemas import ERROR
from meshledger.session import ensure_checkpoint_dir, stage
from meshledger.sources.requests import stream_messages
from meshledger.sources.state import empty_state
from meshledger.sources.store import StateStore
from meshledger.streaming.job import reconcile_stream
from tests.helpers import many_requests
from tests.test_properties import change_list, state_rows


def test_slugs_of_other_scripts(spark):
    names = {"Москва": "moskva", "Большой зал": "bol-shoi-zal", "Ёлка-1": "iolka-1", "Αθήνα": "athena", "Site A": "site-a", "Øst & Vest": "ost-and-vest"}
    frame = spark.createDataFrame([(n,) for n in names], "n string").select("n", slugify(F.col("n")).alias("s"))
    assert {r.n: r.s for r in frame.collect()} == names


def test_moved_value_is_not_steady(spark):
    rows = [(1, "a", [{"site": {"name": "S", "facility": "Lab"}}]), (2, "b", [{"site": {"name": "S", "comments": "Lab"}}])]
    changes = change_list(reconcile(many_requests(spark, rows), empty_state(spark)))
    assert [c[2] for c in changes] == ["create", "update"] and '"comments":"Lab"' in changes[1][4]


def messages(spark, rows):
    requests = many_requests(spark, rows)
    body = F.to_json(F.struct(*[c for c in requests.columns if c != "ingestion_ts"]))
    return requests.select(body.alias("request"), F.col("ingestion_ts").cast("string").alias("ingestion_ts"))


def test_stream_repeats_snapshot_and_refusals(spark):
    """One file delivered twice, two bad arrival times, a stored inventory, and an inventory that refuses a set."""
    landing, root, checkpoint = (tempfile.mkdtemp(prefix=f"meshledger-{n}-") for n in ("in", "out", "cp"))
    stored = stage(reconcile(many_requests(spark, [(1, "old", [{"site": {"name": "Old", "facility": "f"}}])]), empty_state(spark)).state)
    rows = [(5, "a", [{"site": {"name": "Old", "comments": "c"}}, {"site": {"name": "New"}}])]
    late = messages(spark, [(6, "b", [{"site": {"name": "Bad"}}])]).withColumn("ingestion_ts", F.lit("soon"))
    for frame in (messages(spark, rows), messages(spark, rows), late.unionAll(late)):
        frame.coalesce(1).write.mode("append").parquet(landing)

    def refuse(sets):
        bad = sets.where(F.exists("change_set", lambda c: c["data"].contains('"name":"Bad"')))
        return bad.select("change_set_id", F.struct(F.lit("no").alias("message"), F.lit(400).alias("code"),
                                                    F.lit(None).cast(ERROR["details"].dataType).alias("details")).alias("apply_error"))

    query = reconcile_stream(stream_messages(spark, landing, max_files=1), root, checkpoint, hot_rows=None, initial=stored, answers=refuse)
    query.awaitTermination()
    log = spark.read.parquet(f"{root}/log")
    states = sorted((r.request_id, r.state) for r in log.collect())
    assert log.select("id").distinct().count() == log.count()
    refused = log.where("state = 'FAILED'").first()
    assert refused.change_set_id and [c.object_type for c in refused.change_set] == ["dcim.site"]
    assert states == [("a", "NO_CHANGES")] * 2 + [("a", "RECONCILED")] * 2 + [("b", "FAILED")] * 2
    final = {r.object_key: (r.facility, r.comments) for r in StateStore(root).snapshot(spark, 2).rows().where("object_type = 'dcim.site'").collect()}
    assert final == {"Old": ("f", "c"), "New": (None, None)}
    plain = reconcile(many_requests(spark, rows + rows), stored)
    assert state_rows(plain.state) == state_rows(StateStore(root).snapshot(spark, 2).rows())
    with pytest.raises(FileNotFoundError):
        StateStore(root).snapshot(spark, 0)  # versions before the last two are gone


def test_shared_folder_is_demanded_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None

    class Session:
        sparkContext = Context

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(ValueError):
        ensure_checkpoint_dir(Session)


def test_copies_of_a_hot_key_are_spread(spark):
    """A third of all requests share a time and an empty id: numbered without gaps, and no range holds them all."""
    from meshledger.operators.flatten import number_copies

    rows = [(0, "", [{"site": {"name": f"s{i % 50}"}}]) for i in range(300)] + [(i, f"r{i}", [{"site": {"name": "x"}}]) for i in range(1, 601)]
    requests = many_requests(spark, rows + [(5, "r5", [{"site": {"name": "y"}}])]).repartition(6)
    earlier = spark.createDataFrame([(5, "r5", 3), (7, "r7", 1)], "ingestion_ts long, id string, n long")
    numbered = number_copies(requests, earlier)
    copies = {}
    for r in numbered.select("ingestion_ts", "id", "copy").collect():
        copies.setdefault((r.ingestion_ts, r.id), []).append(r.copy)
    assert sorted(copies.pop((0, ""))) == list(range(300))
    assert sorted(copies.pop((5, "r5"))) == [3, 4] and copies.pop((7, "r7")) == [1]
    assert all(v == [0] for v in copies.values()) and len(copies) == 598


def test_only_allowed_sources_are_taken(spark):
    landing, root, checkpoint = (tempfile.mkdtemp(prefix=f"meshledger-{n}-") for n in ("in", "out", "cp"))
    rows = messages(spark, [(1, "a", [{"site": {"name": "A"}}]), (2, "b", [{"site": {"name": "B"}}])])
    rows.withColumn("request", F.when(F.col("request").contains('"id":"b"'), F.replace("request", F.lit('"agent"'), F.lit('"other"')))
                    .otherwise(F.col("request"))).coalesce(1).write.mode("append").parquet(landing)
    sources = spark.createDataFrame([("agent",)], "name string")
    reconcile_stream(stream_messages(spark, landing), root, checkpoint, hot_rows=None, sources=sources).awaitTermination()
    assert [r.object_key for r in StateStore(root).snapshot(spark, 0).rows().collect()] == ["A"]
