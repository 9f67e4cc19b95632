"""Parents do not depend on where a batch ends: one, three and very many batches give equal changes and states."""

import random

import pytest

from meshledger.plans.reconcile import find_changes, present_shape, reconcile
from meshledger.registry import ALL, SLOTS, shape_of
from meshledger.session import stage
from meshledger.sources.state import empty_state
from tests.helpers import UNDEFINED, changes_of, key, many_requests, run, stored
from tests.test_properties import change_list, mixed_requests, state_rows


def in_batches(spark, rows, state, number):
    changes, size = [], -(-len(rows) // number)
    for low in range(0, len(rows), size):
        result = reconcile(many_requests(spark, rows[low : low + size]), state, hot_rows=None)
        changes += change_list(result)
        state = stage(result.state)
    return changes, state_rows(state)


def wandering(seed, n):
    """Holders of all types whose parents are absent, blank, real and real again, with few other fields that change."""
    pick = random.Random(seed)
    some = lambda *values: pick.choice(values)
    rows = []
    for i in range(n):
        site = some(None, {"name": "S"})
        device = {"name": "d", "site": {"name": "S"}, "platform": some(None, None, {"name": "ios"}, {"name": "eos"}, {"name": ""}),
                  "role": some(None, {"name": "r1"}, {"name": "r2"}), "serial": some(None, None, None, str(i))}
        cluster = some(None, None, {"name": ""}, {"name": "c1", "group": some(None, {"name": "g"})}, {"name": "c2"})
        entity = some(
            {"device": device}, {"device": device}, {"interface": {"name": "e", "device": device}},
            {"virtual_machine": {"name": "v", "site": {"name": "S"}, "cluster": cluster, "memory": some(None, None, i),
                                 "platform": some(None, {"name": "ios"}, {"name": ""})}},
            {"prefix": {"prefix": "10.0.0.0/8", "site": site, "description": some(None, None, f"x{i}")}},
            {"cluster": {"name": "c1", "group": some(None, {"name": "g"}, {"name": "h"}), "type": some(None, {"name": "t"})}},
            {"platform": {"name": some("ios", "eos"), "description": some(None, None, f"p{i}")}})
        rows.append((i + 1, f"r{i}", [entity]))
    return rows


def test_batches_change_nothing(spark):
    """Devices, machines, prefixes and clusters of an inventory that knows none of their parents."""
    objects = [
        ("dcim.site", "S", {"id": 1, "name": "S", "slug": "s", "status": {"value": "active"}}),
        ("dcim.platform", key("ios", ""), {"id": 2, "name": "ios", "slug": "ios"}),
        ("dcim.device", key("d", "S"), {"id": 3, "name": "d", "site": {"id": 1, "name": "S"}}),
        ("ipam.prefix", "10.0.0.0/8", {"id": 4, "prefix": "10.0.0.0/8"}),
        ("virtualization.cluster", key("c1", ""), {"id": 5, "name": "c1"}),
        ("virtualization.virtualmachine", key("v", "S"), {"id": 6, "name": "v", "site": {"id": 1, "name": "S"}}),
        ("dcim.devicerole", "r1", {"id": 7, "name": "r1", "slug": "r1", "color": "000000"}),
        ("dcim.site", "undefined", {"id": 8, **UNDEFINED, "status": {"value": "active"}}),
    ]
    state, rows = stored(spark, objects), wandering(5, 8)
    whole = in_batches(spark, rows, state, 1)
    assert whole[0] and in_batches(spark, rows, state, 3) == whole
    assert in_batches(spark, rows, state, len(rows)) == whole


def test_mixed_requests_in_three_batches(spark):
    rows = mixed_requests(spark, 30)
    assert in_batches(spark, rows, empty_state(spark), 3) == in_batches(spark, rows, empty_state(spark), 1)


def test_silent_parent_is_attached_by_a_change(spark):
    objects = [("dcim.site", "S", {"id": 1, "name": "S", "slug": "s", "status": {"value": "active"}}),
               *[("dcim.platform", key(n, ""), {"id": i, "name": n, "slug": n}) for i, n in ((2, "ios"), (3, "eos"))],
               ("dcim.manufacturer", "undefined", {"id": 4, **UNDEFINED}),
               ("dcim.devicetype", key("undefined", "undefined"), {"id": 5, "model": "undefined", "slug": "undefined", "manufacturer": {"id": 4, **UNDEFINED}}),
               ("dcim.devicerole", "undefined", {"id": 6, **UNDEFINED, "color": "000000"}),
               ("dcim.device", key("d", "S"), {"id": 7, "name": "d", "site": {"id": 1, "name": "S"}, "status": {"value": "active"},
                "role": {"id": 6, **UNDEFINED}, "device_type": {"id": 5, "model": "undefined", "manufacturer": {"id": 4, **UNDEFINED}}})]

    def device(**more):
        return {"device": {"name": "d", "site": {"name": "S"}, **more}}

    seen = [device(platform={"name": "ios"}), device(platform={"name": "eos"}), device(serial="1"),
            device(platform={"name": "eos"}, serial="2"), device(), device(platform={"name": ""}, serial="3"), device(platform={"name": "ios"})]
    got = [(data.get("serial"), (data.get("platform") or {}).get("id")) for _, kind, data in changes_of(run(spark, seen, objects)) if kind == "dcim.device"]
    assert got == [("1", None), ("2", 3), ("3", 3), ("3", 2)]


@pytest.mark.parametrize("name", ["dcim.site", "dcim.devicetype", "dcim.interface", "ipam.ipaddress", "virtualization.virtualdisk"])
def test_shapes_are_closed(name):
    shape = shape_of([name])
    assert all(p in shape.slots for s in shape.slots for p in SLOTS[s].parents.values())
    assert set(shape.scalars) >= {c for t in shape.types.values() for c in t.scalars}


def test_shape_of_a_batch_changes_nothing(spark, monkeypatch):
    """Planned for its own types or for all, a batch gives the same changes."""
    from meshledger.operators.flatten import classify_roots, explode_entities
    from meshledger.plans import reconcile as plan

    for pick in (3,):
        rows = [r for i, r in enumerate(mixed_requests(spark, 40)) if i % 6 == pick]
        roots = stage(classify_roots(explode_entities(many_requests(spark, rows))))
        assert set(present_shape(roots).slots) < set(ALL.slots)
        listed = lambda: [tuple(r) for r in find_changes(roots, empty_state(spark)).select(
            "seq", "ord", "change_type", "object_type", "data").orderBy("seq", "ord").collect()]
        own = listed()
        monkeypatch.setattr(plan, "present_shape", lambda _: ALL)
        assert own and listed() == own
        monkeypatch.undo()
