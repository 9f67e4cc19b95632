"""Named queries over the given tables, each with the SQL that states the same result."""

from meshledger.catalog import delivery, ingest, jobs, logs, parents, state, stream
from meshledger.catalog.observe import REGISTRY

__all__ = ["REGISTRY", "delivery", "ingest", "jobs", "logs", "parents", "state", "stream"]
