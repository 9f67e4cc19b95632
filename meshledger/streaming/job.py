"""The reconcile job on a stream: every batch reads the state the one before it left."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from meshledger.operators.carry import HOT_ROWS
from meshledger.operators.logs import COUNTED_STATES, log_records, with_change_sets
from meshledger.operators.flatten import classify_roots, explode_entities, number_copies
from meshledger.operators.validate import allowed_requests, check_envelope
from meshledger.plans.reconcile import reconcile
from meshledger.session import release, stage
from meshledger.sources.log_table import LogTable
from meshledger.sources.requests import parse_messages, quarantined_messages, usable_requests
from meshledger.sources.store import BUCKETS, StateStore


@dataclass(frozen=True)
class Paths:
    """Folders of one job. Each batch owns a sub-folder in each, so a repeated batch replaces its own."""

    root: str

    def of(self, table: str, batch: int) -> str:
        return f"{self.root}/{table}/batch={batch:012d}"

    def all(self, table: str) -> str:
        return f"{self.root}/{table}"


def run_batch(messages: DataFrame, batch: int, paths: Paths, hot_rows: int | None = HOT_ROWS,
              initial: DataFrame | None = None, answers: Callable[[DataFrame], DataFrame] | None = None,
              buckets: int = BUCKETS, sources: DataFrame | None = None) -> None:
    """One micro-batch: log it as queued, reconcile, write changes, final log, rejects and the touched part of the state.

    ``answers`` stands for the inventory: given the batch's change sets it returns the refused ones as
    (change_set_id, apply_error). The batch is then reconciled again without these, and asked about again, as
    what came after a refused root may now ask for more; every round refuses a root at least. With ``sources`` (name) only
    requests of these producers are taken."""
    spark = messages.sparkSession
    parsed = stage(parse_messages(messages))
    requests = usable_requests(parsed)
    if sources is not None:
        requests = allowed_requests(requests, sources)
    log = LogTable(paths.all("log"))
    checked = check_envelope(requests).where("request_error IS NULL").drop("request_error")
    earlier = log.delivered(checked, batch)
    earlier = None if earlier is None else stage(earlier)
    log.write(log_records(classify_roots(explode_entities(number_copies(checked, earlier)))), batch)
    store = StateStore(paths.root, buckets)
    if batch == 0:
        store.begin(spark, initial)
    # Batches are numbered without gaps. A state that is gone stops the job: going on empty would create all objects again.
    state = store.snapshot(spark, batch - 1)
    result = reconcile(requests, state, hot_rows=hot_rows, earlier=earlier)
    refused, refused_sets = None, []
    while answers is not None:
        more = stage(answers(result.change_sets))
        if more.isEmpty():
            break
        refused = more if refused is None else refused.unionByName(more)
        refused_sets.append(stage(result.change_sets.join(more.select("change_set_id"), "change_set_id", "left_semi")))
        release(spark, result.changes)
        result = reconcile(requests, state, refused, hot_rows=hot_rows, earlier=earlier)
    result.changes.drop("record").write.mode("overwrite").parquet(paths.of("changes", batch))
    sets = reduce(DataFrame.unionByName, refused_sets, result.change_sets)
    log.write(with_change_sets(result.log, sets), batch)
    result.rejects.write.mode("overwrite").parquet(paths.of("rejects", batch))
    quarantined_messages(parsed).write.mode("overwrite").parquet(paths.of("quarantine", batch))
    # The state comes last: without its manifest the batch counts as not done and is run again.
    store.commit(state, result.state, batch)
    release(spark, parsed, result.changes)


def reconcile_stream(messages: DataFrame, root: str, checkpoint: str, hot_rows: int | None = HOT_ROWS,
                     trigger: dict | None = None, on_batch: Callable[[int], None] | None = None,
                     initial: DataFrame | None = None,
                     answers: Callable[[DataFrame], DataFrame] | None = None, buckets: int = BUCKETS,
                     sources: DataFrame | None = None) -> StreamingQuery:
    """Start the job, on a snapshot of the inventory if ``initial`` is given. At-least-once delivery is made exact
    by the batch number in every path."""
    paths = Paths(root)

    def handle(frame: DataFrame, batch: int) -> None:
        run_batch(frame, batch, paths, hot_rows, initial, answers, buckets, sources)
        if on_batch is not None:
            on_batch(batch)

    return (messages.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def stream_state_changes(log: DataFrame) -> DataFrame:
    """(state, n) corrections over a stream of log records: a later record of an id takes it out of its old state.

    An id's records may come in one batch or in several, queued ones late or not at all, final ones twice. What is remembered is
    when an id was first and last seen queued, and final, by the time Spark gives a batch, so that a late or repeated record counts
    nothing; Spark keeps it by id in the partitions of its state store. A kind of record is new to an id if it was seen at no
    other time than now: batches only need different times, in whatever order a clock gives them. The sum of n by state is the
    count of the latest records."""
    final = [s for s in COUNTED_STATES.values() if s != "QUEUED"]
    now = F.current_timestamp()
    is_final = F.col("state").isin(final)
    kept = log.where(is_final | (F.col("state") == "QUEUED")).select(
        "id", F.when(~is_final, now).alias("queued"), F.when(is_final, now).alias("done"),
        F.when(is_final, F.array_position(F.lit(final), F.col("state")).cast("int")).alias("at"))
    seen = kept.groupBy("id").agg(*[f(c).alias(n + c) for c in ("queued", "done") for f, n in ((F.min, "first_"), (F.max, "last_"))],
                                  F.min("at").alias("at")).withColumn("now", now)
    new = {c: F.coalesce((F.col("first_" + c) == F.col("now")) & (F.col("last_" + c) == F.col("now")), F.lit(False))
           for c in ("queued", "done")}
    queued_before = F.col("first_queued").isNotNull() & ~new["queued"]
    one = lambda state, n: F.struct(state.alias("state"), F.lit(n).cast("bigint").alias("n"))
    entered = F.when(new["done"], one(F.get(F.lit(final), F.col("at") - 1), 1)).when(
        new["queued"] & F.col("first_done").isNull(), one(F.lit("QUEUED"), 1))
    left = F.when(new["done"] & queued_before, one(F.lit("QUEUED"), -1))
    return seen.select(F.inline(F.array_compact(F.array(entered, left))))


def count_states_of_stream(log: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Write the corrections of a log stream to a table by batch, exactly once; :func:`state_totals` sums them."""
    def keep(corrections: DataFrame, batch: int) -> None:
        corrections.groupBy("state").agg(F.sum("n").alias("n")).coalesce(1).write.mode("overwrite").parquet(
            f"{path}/batch={batch:012d}")

    return (stream_state_changes(log).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def state_totals(corrections: DataFrame) -> DataFrame:
    """One row in the form of the log's metrics: the total and the number in every state."""
    in_state = [F.coalesce(F.sum(F.when(F.col("state") == s, F.col("n"))), F.lit(0)).alias(name) for name, s in COUNTED_STATES.items()]
    return corrections.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), *in_state)
