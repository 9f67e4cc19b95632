"""Reconcile a batch of requests with the current state: one set-based plan for all object types."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshledger.operators.attach import attachments, by_object, digest
from meshledger.operators.carry import HOT_ROWS
from meshledger.operators.changes import assemble_change_sets, decide_noted, without_notes
from meshledger.operators.flatten import (
    add_keys, classify_roots, explode_entities, fill_slugs, flatten, lay_out, narrowed, number_copies, present_kinds, whole_entities,
)
from meshledger.operators.fold import fold_observations, state_of_batch
from meshledger.operators.logs import build_log, request_errors, split_rejects
from meshledger.operators.resolve import apply_resolution, resolve_parents
from meshledger.operators.steady import split_steady, steady_keys
from meshledger.operators.tags import attached_tags
from meshledger.operators.touched import touched_state
from meshledger.operators.validate import check_envelope
from meshledger.registry import ALL, Shape, shape_of
from meshledger.session import release, stage
from meshledger.sources.store import FrameState, Snapshot


#: Batches with more nodes than this are decided in so many slices.
SLICED_NODES, SLICES = 4_000_000, 4


@dataclass(frozen=True)
class Reconciled:
    changes: DataFrame      # one row per change, numbered inside its change set
    change_sets: DataFrame  # one row per root with its ordered changes
    state: DataFrame        # the state after the batch; from a snapshot, the buckets it touches
    log: DataFrame          # one record per entity
    errors: DataFrame       # errors per request
    rejects: DataFrame      # requests kept back: bad envelope, or an entity failed


def source_of(state: DataFrame | Snapshot) -> FrameState | Snapshot:
    return FrameState(state) if isinstance(state, DataFrame) else state


def keyed_roots(roots: DataFrame, shape: Shape = ALL) -> DataFrame:
    """Valid roots laid out over the slots, with every object's natural key."""
    valid = roots.where(F.col("root_error").isNull()).select("seq", "entity")
    return add_keys(lay_out(valid), shape)


def present_shape(roots: DataFrame) -> Shape:
    """The shape of the valid roots: at most one row per object type comes to the driver."""
    present = roots.where(F.col("root_error").isNull()).select("object_type").distinct().collect()
    return shape_of(sorted(row[0] for row in present if row[0])) if present else shape_of(["dcim.site"])


def find_changes(roots: DataFrame, state: DataFrame | Snapshot, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """The numbered changes of all valid roots, staged.

    What the state holds of the batch's objects is looked up once. Roots, nodes and changes are written once: parents' look-ups, the fold, the tag history and the counts
    per key all read them, and a lost executor then costs one stage, not the whole lineage. A second round is needed
    only where a parent was seen without being attached (see ``attach``).
    """
    spark = roots.sparkSession
    shape = present_shape(roots)
    keyed = stage(keyed_roots(roots, shape))
    state = touched_state(keyed, source_of(state).look_up, shape)
    assumed, known = None, (0, None)
    while True:
        noted = _changes_under(keyed, state, assumed, hot_rows, shape)
        notes = noted.where(F.col("noted").isNotNull())
        found = None if notes.isEmpty() else stage(attachments(notes))
        seen = (0, None) if found is None else digest(found)
        if seen == known:
            release(spark, keyed, state, *[x for x in (found, assumed) if x is not None])
            return without_notes(noted)
        release(spark, noted, *([] if assumed is None else [assumed]))
        known, assumed = seen, by_object(found) if seen[0] else None
        release(spark, *([] if found is None else [found]))


def _changes_under(keyed: DataFrame, state: DataFrame, since: DataFrame | None, hot_rows: int | None,
                   shape: Shape) -> DataFrame:
    """Changes and notes if parents are attached as ``since`` says, staged; what was staged on the way is deleted."""
    resolved = resolve_parents(keyed, state, limit_for(keyed, hot_rows), since, shape)
    nodes = stage(flatten(apply_resolution(keyed, resolved, shape), shape=shape, slugs=False))
    steady = steady_keys(nodes, state, shape)
    moving, quiet = split_steady(nodes, state, shape, hot_rows, steady)
    moving = stage(fill_slugs(moving))
    limit, number = limit_for(moving, hot_rows), moving.count()
    attached = attached_tags(moving, state, state_of_batch(state, moving, number), limit)
    folded = fold_observations(moving, state, limit, since, shape, attached, number)
    folded, number, used = folded.unionByName(quiet, allowMissingColumns=True), nodes.count(), [nodes, steady, moving]
    if number > SLICED_NODES:
        # Large batches are decided a slice of the roots at a time: nodes with all they ask for take most room in the shuffle by root.
        folded = stage(folded)
        release(keyed.sparkSession, *used)
        used, part = [folded], F.pmod(F.xxhash64("seq"), F.lit(SLICES))
        noted = stage(*[decide_noted(folded.where(part == i), shape, attached, -(-number // SLICES)) for i in range(SLICES)])
    else:
        noted = stage(decide_noted(folded, shape, attached, number))
    release(keyed.sparkSession, *used, *([] if attached is None else [attached]))
    return noted


def limit_for(staged: DataFrame, hot_rows: int | None) -> int | None:
    """No key of a table can have more rows than the table: then nothing has to be counted by key.

    The table is staged, so its number of rows comes from the file footers.
    """
    return hot_rows if hot_rows is not None and staged.count() > hot_rows else None


def reconcile(requests: DataFrame, state: DataFrame | Snapshot, responses: DataFrame | None = None,
              hot_rows: int | None = HOT_ROWS, earlier: DataFrame | None = None) -> Reconciled:
    """The state is a table, or a snapshot of a store: then ``Reconciled.state`` has the touched buckets alone.

    ``responses`` may hold what an inventory answered: (change_set_id, apply_error). A refused root takes no
    part in the fold: nothing later is compared with values that the inventory never took. ``earlier`` may tell which
    requests came before (see ``number_copies``).

    Roots are classified once and written; the changes, the log and the errors read them."""
    kinds = present_kinds(requests)
    checked = check_envelope(requests.withColumn("entities", F.transform("entities", lambda e: narrowed(e, kinds))))
    good = number_copies(checked.where(F.col("request_error").isNull()).drop("request_error"), earlier)
    roots = stage(classify_roots(explode_entities(good)))
    taken = roots
    if responses is not None:
        taken = roots.join(responses.select(F.col("change_set_id").alias("_refused")),
                           F.md5("seq") == F.col("_refused"), "left_anti")
    changes = find_changes(taken, state, hot_rows)
    errors = request_errors(roots, responses)
    _, failed = split_rejects(good, errors)
    rejects = checked.where(F.col("request_error").isNotNull()).withColumn(
        "errors", F.array("request_error")).drop("request_error").unionByName(failed.drop("copy"))
    rejects = rejects.withColumn("entities", whole_entities(F.col("entities"), rejects.schema["entities"].dataType))
    return Reconciled(changes, assemble_change_sets(changes), source_of(state).after(changes),
                      build_log(roots, changes, responses, roots.count()), errors.drop("copy"), rejects)
