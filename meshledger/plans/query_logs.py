"""Log queries: one page with its metrics and the token of the next page, or the metrics alone."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from meshledger.operators.logs import LogQuery, count_states, listing_metrics, log_page, next_token


@dataclass(frozen=True)
class LogPage:
    logs: DataFrame
    metrics: DataFrame
    next_page_token: str


def query_logs(log: DataFrame, query: LogQuery) -> LogPage:
    """A token is given whenever the page is full, even if nothing follows."""
    page = log_page(log, query)
    return LogPage(page, listing_metrics(log, query), next_token(log, query, page.count()))


def log_metrics(log: DataFrame) -> DataFrame:
    """Total and count per state in one aggregate."""
    return count_states(log)
