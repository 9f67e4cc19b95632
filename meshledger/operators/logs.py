"""The ingestion log: records per entity, latest per id, filters, pages, counts."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshledger.functions.scalars import (
    log_id, log_key, normalized_error, page_offset, page_token, unquote_ingestion_ts,
)
from meshledger.operators.flatten import whole
from meshledger.operators.salts import dealt, shuffled

COUNTED_STATES = {"queued": "QUEUED", "reconciled": "RECONCILED", "failed": "FAILED",
                  "no_changes": "NO_CHANGES"}
DEFAULT_PAGE = 100
PAGE_LIMIT = 1000


def log_records(roots: DataFrame) -> DataFrame:
    """The record every typed entity starts with, before it is reconciled."""
    entity = whole(F.col("entity"), roots.schema["entity"].dataType)
    return roots.where(F.col("object_type").isNotNull()).select(
        "seq", log_id(F.col("ingestion_ts"), F.col("id"), F.col("position"), F.col("copy")).alias("id"),
        F.col("object_type").alias("data_type"), F.lit("QUEUED").alias("state"),
        F.col("id").alias("request_id"), "ingestion_ts", "producer_app_name", "producer_app_version",
        "sdk_name", "sdk_version", F.to_json(F.when(F.col("entity").isNotNull(), entity)).alias("entity"), "copy", "root_error")


def final_state(error: Column, change_set_id: Column) -> Column:
    return F.when(error.isNotNull(), "FAILED").when(change_set_id.isNotNull(), "RECONCILED").otherwise("NO_CHANGES")


def build_log(roots: DataFrame, change_sets: DataFrame, apply_errors: DataFrame | None = None,
              number: int | None = None) -> DataFrame:
    """Final record per entity: FAILED with its error, RECONCILED with its change set, or NO_CHANGES. ``number`` tells how many
    roots there are."""
    rows = dealt(log_records(roots).drop("state"), number, "seq").join(
        shuffled(change_sets.select("seq", "change_set_id").distinct(), number or 0), "seq", "left")
    if apply_errors is not None:
        # A refused change set is no longer among the changes; its id follows from the root.
        refused = apply_errors.withColumnRenamed("change_set_id", "_refused")
        rows = rows.join(refused, F.md5("seq") == F.col("_refused"), "left").withColumn(
            "change_set_id", F.coalesce("change_set_id", "_refused")).drop("_refused")
    else:
        from meshledger.schemas import ERROR

        rows = rows.withColumn("apply_error", F.lit(None).cast(ERROR))
    error = normalized_error(F.col("apply_error"), F.col("root_error"))
    return rows.withColumn("error", error).select(
        "id", "data_type", final_state(F.col("error"), F.col("change_set_id")).alias("state"),
        "request_id", "ingestion_ts", "producer_app_name", "producer_app_version", "sdk_name",
        "sdk_version", "entity", "error", "change_set_id", "copy")


def with_change_sets(log: DataFrame, change_sets: DataFrame) -> DataFrame:
    """Records with the changes of their change set."""
    return log.join(change_sets.select("change_set_id", "change_set"), "change_set_id", "left")


def day_of(ingestion_ts: Column) -> Column:
    """Days since 1970 of an arrival time."""
    return F.floor(ingestion_ts / F.lit(86_400_000_000_000)).cast("int")


def with_log_key(log: DataFrame) -> DataFrame:
    return log.withColumn("log_key", log_key(F.col("data_type"), F.col("ingestion_ts"), F.col("id")))


def normalized_json(record: Column) -> Column:
    return unquote_ingestion_ts(F.to_json(record))


def request_errors(roots: DataFrame, apply_errors: DataFrame | None = None) -> DataFrame:
    """Errors of a request in entity order."""
    message = F.col("root_error")
    rows = roots
    if apply_errors is not None:
        rows = roots.withColumn("change_set_id", F.md5("seq")).join(apply_errors, "change_set_id", "left")
        message = F.coalesce(F.col("apply_error.message"), message)
    bad = rows.withColumn("_message", message).where(F.col("_message").isNotNull())
    return bad.groupBy("id", "ingestion_ts", "copy").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", "_message"))),
                    lambda e: e["_message"]).alias("errors"))


def split_rejects(requests: DataFrame, errors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests without errors, requests with errors and the errors)."""
    keys = ["id", "ingestion_ts", "copy"]
    if "copy" not in requests.columns:
        requests = requests.withColumn("copy", F.lit(0))
    return requests.join(errors, keys, "left_anti"), requests.join(errors, keys)


def latest_log(log: DataFrame, order: str) -> DataFrame:
    """A later write of an id replaces the earlier one; the aggregate combines before it shuffles."""
    return log.groupBy("id").agg(F.max_by(F.struct(*[c for c in log.columns if c != "id"]),
                                          order).alias("r")).select("id", "r.*")


@dataclass(frozen=True)
class LogQuery:
    page_size: int | None = None
    state: str | None = None
    data_type: str = ""
    request_id: str = ""
    ingestion_ts_start: int = 0
    ingestion_ts_end: int = 0
    page_token: str = ""
    producer_app_name: str = ""


def log_filters(query: LogQuery) -> list[Column]:
    found = []
    if query.ingestion_ts_start > 0 or query.ingestion_ts_end > 0:
        found.append(F.col("ingestion_ts") >= query.ingestion_ts_start)
        if query.ingestion_ts_end > 0:
            found.append(F.col("ingestion_ts") <= query.ingestion_ts_end)
    if query.state is not None:
        found.append(F.col("state") == query.state)
    for column in ("data_type", "request_id", "producer_app_name"):
        if getattr(query, column):
            found.append(F.col(column) == getattr(query, column))
    return found


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(and_, conditions, F.lit(True))


def day_filters(query: LogQuery) -> list[Column]:
    """The time filter in days, which prunes the partitions of a log that has them."""
    if query.ingestion_ts_start <= 0 and query.ingestion_ts_end <= 0:
        return []
    day = lambda ts: ts // 86_400_000_000_000
    found = [F.col("day") >= day(query.ingestion_ts_start)]
    return found + [F.col("day") <= day(query.ingestion_ts_end)] * (query.ingestion_ts_end > 0)


def filter_log(log: DataFrame, query: LogQuery) -> DataFrame:
    return log.where(all_of([*log_filters(query), *(day_filters(query) if "day" in log.columns else [])]))


def page_size_of(query: LogQuery) -> int:
    if query.page_size is None or query.page_size >= PAGE_LIMIT:
        return DEFAULT_PAGE
    return query.page_size


def read_token(log: DataFrame, token: str) -> int:
    """Offset of a page token, by the same expression queries use."""
    if not token:
        return 0
    one = log.sparkSession.range(1).select(page_offset(F.lit(token)).alias("offset"))
    return one.first()["offset"]


#: Offsets up to this are answered by a top-k; deeper pages by counting ranges of ids first.
DIRECT = 10_000
#: Ids that the ranges are cut on.
RANGES = 2_048


def log_page(log: DataFrame, query: LogQuery, direct: int = DIRECT, ranges: int = RANGES) -> DataFrame:
    """The page: newest id first. A shallow one is a top-k; of a deep one only the ranges of ids it lies in are sorted."""
    offset, size = read_token(log, query.page_token), page_size_of(query)
    found = filter_log(log, query)
    if offset > direct:
        found, offset = ranges_of_page(found, offset, size, ranges)
    return found.orderBy(F.desc("id")).offset(offset).limit(size)


def ranges_of_page(found: DataFrame, offset: int, size: int, ranges: int) -> tuple[DataFrame, int]:
    """The rows of the ranges of ids that hold places ``offset`` to ``offset + size``, and the offset among them.

    The cuts come from a bounded sample by hash, so they only balance the work; counts per range, which combine within a task,
    say where the page lies. The driver sees cuts and counts, and no task more than a few ranges."""
    sample = found.select("id").orderBy(F.xxhash64("id"), "id").limit(ranges).collect()
    cuts = sorted({row[0] for row in sample}, reverse=True)
    if not cuts:
        return found, offset
    # Range i holds the ids from cut i on, up to the cut before it; the last one all below the smallest cut.
    array = F.array(*[F.lit(c) for c in cuts])
    place = F.size(F.filter(array, lambda cut: cut > F.col("id")))
    counts = dict(found.groupBy(place.alias("range")).count().collect())
    above, first, last = 0, None, len(cuts)
    for i in range(len(cuts) + 1):
        if first is None and above + counts.get(i, 0) > offset:
            first, skipped = i, above
        above += counts.get(i, 0)
        if above >= offset + size:
            last = i
            break
    if first is None:
        return found.where(F.lit(False)), 0
    below = F.col("id") < cuts[first - 1] if first > 0 else F.lit(True)
    above = F.col("id") >= cuts[last] if last < len(cuts) else F.lit(True)
    return found.where(below & above), offset - skipped


def next_token(log: DataFrame, query: LogQuery, returned: int) -> str:
    if returned != page_size_of(query):
        return ""
    offset = read_token(log, query.page_token) + returned
    one = log.sparkSession.range(1).select(page_token(F.lit(offset).cast("bigint")).alias("token"))
    return one.first()["token"]


def count_states(log: DataFrame, *by: str) -> DataFrame:
    counts = [F.count("*").alias("total")]
    counts += [F.count_if(F.col("state") == s).alias(name) for name, s in COUNTED_STATES.items()]
    return log.groupBy(*by).agg(*counts) if by else log.agg(*counts)


def listing_metrics(log: DataFrame, query: LogQuery) -> DataFrame:
    """Number of hits, in the field of the filtered state, else in ``total``; the rest is 0."""
    names = {"UNSPECIFIED": "total"} | {s: n for n, s in COUNTED_STATES.items()}
    target = names.get(query.state, "total") if query.state is not None else "total"
    hits = filter_log(log, query).agg(F.count("*").alias("hits"))
    return hits.select(*[(F.col("hits") if n == target else F.lit(0).cast("bigint")).alias(n)
                         for n in ("total", *COUNTED_STATES)])
