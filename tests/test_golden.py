"""Cases with an exact, ordered list of changes.

One request carries many cases: their objects have names of their own, so they do not meet.
"""

import pytest

from tests.helpers import UNDEFINED, changes_by_position, changes_of, key, run

SITE_U = {"id": 1, **UNDEFINED, "status": "active"}
MAKER_U = {"id": 1, **UNDEFINED}
ROLE_U = {"id": 1, **UNDEFINED, "color": "000000"}
TYPE_U = {"id": 1, "model": "undefined", "slug": "undefined", "manufacturer": MAKER_U}
PLATFORM_U = {"id": 1, **UNDEFINED, "manufacturer": MAKER_U}
GROUP_U = KIND_U = {"id": 1, **UNDEFINED}
T1, T3 = {"id": 1, "name": "tag 1", "slug": "tag-1"}, {"id": 3, "name": "tag 3", "slug": "tag-3"}
LOREM = "Lorem ipsum dolor sit amet, consectetur adipiscing elit."
CISCO, DELL = {"id": 11, "name": "Cisco", "slug": "cisco"}, {"id": 12, "name": "Dell", "slug": "dell"}
SITE_A = {"id": 31, "name": "Site A", "slug": "site-a", "status": "active"}
SITE_P = {"id": 32, "name": "Site P", "slug": "site-p", "status": "active"}
ROLE_WAN = {"id": 9, "name": "WAN", "slug": "wan", "color": "111111"}
KIND_9 = {"id": 8, "model": "ISR9", "slug": "isr9", "manufacturer": CISCO}


def device(name, ident, **more):
    return {"id": ident, "name": name, "site": SITE_U, "device_type": TYPE_U, "role": ROLE_U,
            "status": "active", **more}


DEVICE_U = device("undefined", 1, platform=PLATFORM_U)
ROUTER_I = device("router-i", 60)
PORT_I = {"id": 61, "name": "eth0", "device": ROUTER_I, "type": "other", "mtu": 1500, "enabled": True}
PORT_0 = {"id": 1, "name": "GigabitEthernet0/0/0", "type": "other", "device": DEVICE_U}
PORT_1 = {"id": 2, "name": "GigabitEthernet1/0/1", "type": "other", "device": DEVICE_U}
VM = {"name": "vm", "site": SITE_U, "status": "active"}

STATE = [
    ("dcim.site", "undefined", SITE_U), ("dcim.manufacturer", "undefined", MAKER_U),
    ("dcim.devicetype", key("undefined", "undefined"), TYPE_U), ("dcim.devicerole", "undefined", ROLE_U),
    ("dcim.platform", key("undefined", ""), PLATFORM_U), ("dcim.device", key("undefined", "undefined"), DEVICE_U),
    ("virtualization.clustergroup", "undefined", GROUP_U), ("virtualization.clustertype", "undefined", KIND_U),
    ("extras.tag", "tag 1", T1), ("dcim.manufacturer", "Dell", DELL),
    ("dcim.site", "Site 1", {"id": 2, "name": "Site 1", "slug": "site-1", "status": {"value": "active", "label": "Active"}}),
    ("dcim.site", "Site T", {"id": 3, "name": "Site T", "slug": "site-t", "status": "active", "tags": [T1, T3]}),
    ("dcim.devicerole", "Edge", {"id": 4, "name": "Edge", "slug": "edge", "color": "111111"}),
    ("dcim.devicerole", "Core", {"id": 5, "name": "Core", "slug": "core", "color": "222222"}),
    ("dcim.devicetype", key("ISR1", "Dell"), {"id": 6, "model": "ISR1", "slug": "isr1", "manufacturer": CISCO}),
    ("dcim.device", key("r-none", "undefined"), device("r-none", 20)),
    ("dcim.device", key("r-blank", "undefined"), device("r-blank", 21)),
    ("dcim.device", key("r-miss", "Site M"), device(
        "r-miss", 22, site={"id": 40, "name": "Site B", "slug": "site-b", "status": "active"},
        device_type={"id": 41, "model": "ISR4322", "slug": "isr4322", "manufacturer": MAKER_U},
        platform=PLATFORM_U, description=LOREM, serial="123456")),
    ("dcim.site", "Site A", SITE_A), ("dcim.site", "Site P", SITE_P),
    ("dcim.device", key("r-real", "Site A"), device("r-real", 23, site=SITE_A, device_type=KIND_9, role=ROLE_WAN,
                                                    platform={"id": 50, "name": "ios", "slug": "ios"})),
    ("dcim.device", key("r-part", "Site A"), device("r-part", 24, site=SITE_A, device_type=KIND_9, role=ROLE_WAN,
                                                    platform={"id": 50, "name": "ios", "slug": "ios"})),
    ("dcim.device", key("r-prop", "Site P"), device("r-prop", 25, site=SITE_P)),
    ("dcim.device", key("router-i", "undefined"), ROUTER_I),
    ("dcim.interface", key("eth0", "router-i", "undefined"), PORT_I),
    ("dcim.interface", key("GigabitEthernet0/0/0", "undefined", "undefined"), PORT_0),
    ("dcim.interface", key("GigabitEthernet1/0/1", "undefined", "undefined"), PORT_1),
    # The inventory answers the look-up of this address on port 1 with the same address on port 0.
    ("ipam.ipaddress", key("192.168.0.1/22", "GigabitEthernet1/0/1", "undefined", "undefined"), {
        "id": 1, "address": "192.168.0.1/22", "status": "active", "AssignedObject": {"Interface": PORT_0}}),
    ("ipam.ipaddress", key("10.0.0.1/8", "GigabitEthernet0/0/0", "undefined", "undefined"), {
        "id": 2, "address": "10.0.0.1/8", "status": "active", "assigned_object": {"interface": PORT_0}}),
    ("ipam.ipaddress", key("10.0.0.2/8", "", "", ""), {"id": 3, "address": "10.0.0.2/8", "status": "active"}),
    ("ipam.prefix", "192.168.0.0/32", {"id": 1, "prefix": "192.168.0.0/32", "site": SITE_U, "status": "active"}),
    ("virtualization.cluster", key("bare", "undefined"), {
        "id": 1, "name": "bare", "site": SITE_U, "group": GROUP_U, "type": KIND_U}),
    ("virtualization.cluster", key("live", "undefined"), {
        "id": 2, "name": "live", "site": SITE_U, "group": GROUP_U, "type": KIND_U, "status": "active"}),
    ("virtualization.virtualmachine", key("vm-none", "undefined"), {**VM, "id": 1, "name": "vm-none", "cluster": {
        "id": 1, "name": "bare", "site": SITE_U, "group": GROUP_U, "type": KIND_U}}),
    ("virtualization.virtualmachine", key("vm-new", "undefined"), {**VM, "id": 2, "name": "vm-new"}),
    ("virtualization.virtualmachine", key("vm-disk", "undefined"), {**VM, "id": 3, "name": "vm-disk"}),
    ("virtualization.virtualdisk", key("disk", "vm-disk", "undefined"), {
        "id": 1, "name": "disk", "size": 1234, "virtual_machine": {**VM, "id": 3, "name": "vm-disk"}}),
    ("virtualization.vminterface", key("nic", "vm-disk", "undefined"), {
        "id": 1, "name": "nic", "mtu": 1500, "virtual_machine": {**VM, "id": 3, "name": "vm-disk"}}),
]
NEW_SITE = {"name": "Site M", "slug": "site-m", "status": "active"}
NEW_KIND = {"model": "ISR4321", "slug": "isr4321", "manufacturer": {"id": 1}}
NEW_ROLE = {"name": "WAN Router", "slug": "wan-router", "color": "000000"}
SITE_P2 = {**SITE_P, "facility": "F1"}
CLUSTER_3 = {"name": "Cluster-3", "status": "active", "group": {"id": 1}, "type": {"id": 1}, "site": {"id": 1}}

CASES = {
    "known site": ({"site": {"name": "Site 1"}}, []),
    "site tags": ({"site": {"name": "Site T", "tags": [{"name": "tag 1"}, {"name": "tag 2"}]}}, [
        ("create", "extras.tag", {"name": "tag 2", "slug": "tag-2"}),
        ("update", "dcim.site", {"id": 3, "name": "Site T", "slug": "site-t", "status": "active",
                                 "tags": [T1, T3, {"name": "tag 2", "slug": "tag-2"}]})]),
    "role description": ({"device_role": {"name": "Edge", "description": "new"}}, [
        ("update", "dcim.devicerole", {"id": 4, "name": "Edge", "slug": "edge", "color": "111111", "description": "new"})]),
    "role same color": ({"device_role": {"name": "Core", "color": "222222"}}, []),
    "type moves to a known maker": ({"device_type": {"model": "ISR1", "manufacturer": {"name": "Dell"}}}, [
        ("update", "dcim.devicetype", {"id": 6, "model": "ISR1", "slug": "isr1", "manufacturer": {"id": 12}})]),
    "known device": ({"device": {"name": "r-none"}}, []),
    "known device, blank site": ({"device": {"name": "r-blank", "site": {"name": ""}}}, []),
    "device gets missing parents": ({"device": {
        "name": "r-miss", "device_type": {"model": "ISR4321"}, "role": {"name": "WAN Router"}, "site": {"name": "Site M"},
        "status": "active", "description": LOREM, "serial": "123456", "tags": [{"name": "tag 1"}]}}, [
        ("create", "dcim.site", NEW_SITE), ("create", "dcim.devicetype", NEW_KIND),
        ("create", "dcim.devicerole", NEW_ROLE),
        ("update", "dcim.device", {
            "id": 22, "name": "r-miss", "site": NEW_SITE, "device_type": NEW_KIND, "role": NEW_ROLE,
            "platform": {"id": 1}, "status": "active", "description": LOREM, "serial": "123456", "tags": [T1]})]),
    "placeholders keep real parents": ({"device": {"name": "r-real", "site": {"name": "Site A"}}}, []),
    "partial data": ({"device": {"name": "r-part", "site": {"name": "Site A"}, "serial": "1"}}, [
        ("update", "dcim.device", {"id": 24, "name": "r-part", "site": {"id": 31}, "device_type": {"id": 8},
                                   "role": {"id": 9}, "platform": {"id": 50}, "status": "active", "serial": "1"})]),
    "changed parent": ({"device": {"name": "r-prop", "site": {"name": "Site P", "facility": "F1"}}}, [
        ("update", "dcim.site", SITE_P2),
        ("update", "dcim.device", {"id": 25, "name": "r-prop", "site": SITE_P2, "device_type": {"id": 1},
                                   "role": {"id": 1}, "status": "active"})]),
    "same interface": ({"interface": {"name": "eth0", "device": {"name": "router-i"}}}, []),
    "interface label": ({"interface": {"name": "eth0", "device": {"name": "router-i"}, "label": "up", "enabled": False}}, [
        ("update", "dcim.interface", {"id": 61, "name": "eth0", "device": {"id": 60}, "type": "other", "mtu": 1500,
                                      "enabled": False, "label": "up"})]),
    "address answered on another port": ({"ip_address": {
        "address": "192.168.0.1/22", "interface": {"name": "GigabitEthernet1/0/1"}}}, [
        ("create", "ipam.ipaddress", {"address": "192.168.0.1/22", "status": "active", "assigned_object": {
            "interface": {"id": 2, "device": {"id": 1}}}})]),
    "address without port": ({"ip_address": {"address": "10.0.0.2/8"}}, []),
    "address description": ({"ip_address": {"address": "10.0.0.1/8", "description": "new",
                                            "interface": {"name": "GigabitEthernet0/0/0"}}}, [
        ("update", "ipam.ipaddress", {"id": 2, "address": "10.0.0.1/8", "status": "active", "description": "new",
                                      "assigned_object": {"interface": {"id": 1, "device": {"id": 1}}}})]),
    "prefix tag": ({"prefix": {"prefix": "192.168.0.0/32", "tags": [{"name": "tag 100"}]}}, [
        ("create", "extras.tag", {"name": "tag 100", "slug": "tag-100"}),
        ("update", "ipam.prefix", {"id": 1, "prefix": "192.168.0.0/32", "site": {"id": 1}, "status": "active",
                                   "tags": [{"name": "tag 100", "slug": "tag-100"}]})]),
    "cluster without status": ({"cluster": {"name": "bare"}}, []),
    "cluster status is not carried": ({"cluster": {"name": "live"}}, [
        ("update", "virtualization.cluster", {"id": 2, "name": "live", "site": {"id": 1}, "group": {"id": 1},
                                              "type": {"id": 1}})]),
    "machine with its cluster": ({"virtual_machine": {"name": "vm-none", "cluster": {"name": "bare"}}}, []),
    "machine gets a new cluster": ({"virtual_machine": {"name": "vm-new", "cluster": {"name": "Cluster-3"}}}, [
        ("create", "virtualization.cluster", CLUSTER_3),
        ("update", "virtualization.virtualmachine", {"id": 2, "name": "vm-new", "cluster": CLUSTER_3, "role": {"id": 1},
                                                     "site": {"id": 1}, "status": "active"})]),
    "disk size is not carried": ({"virtual_disk": {"name": "disk", "virtual_machine": {"name": "vm-disk"}}}, [
        ("update", "virtualization.virtualdisk", {"id": 1, "name": "disk", "virtual_machine": {"id": 3}})]),
    "machine interface": ({"vminterface": {"name": "nic", "virtual_machine": {"name": "vm-disk"}, "mtu": 9000}}, [
        ("update", "virtualization.vminterface", {"id": 1, "name": "nic", "mtu": 9000, "virtual_machine": {"id": 3}})]),
    "blank root": ({"site": {"name": ""}}, []),
}


@pytest.fixture(scope="module")
def known(spark):
    return changes_by_position(run(spark, [e for e, _ in CASES.values()], STATE))


@pytest.mark.parametrize("name", list(CASES))
def test_known_objects(known, name):
    assert known.get(list(CASES).index(name), []) == CASES[name][1]


BLANK = [{"site": {"name": ""}}, {"device_role": {"name": ""}}, {"manufacturer": {}}, {"device_type": {"model": ""}},
         {"device": {"name": ""}}, {"platform": {"name": ""}}, {"interface": {"name": ""}},
         {"ip_address": {"address": ""}}, {"prefix": {"prefix": ""}}, {"cluster_group": {"name": ""}},
         {"cluster_type": {"name": ""}}, {"cluster": {"name": ""}}, {"virtual_machine": {"name": ""}},
         {"vminterface": {"name": ""}}, {"virtual_disk": {"name": ""}},
         {"interface": {"name": "x", "type": "laser"}}, {"ip_address": {"address": "1.1.1.1", "role": "king"}}, {}]


def test_new_device_and_bad_roots(spark):
    result = run(spark, [
        {"device": {"name": "router01"}}, {"site": {"name": "Site A"}}, *BLANK,
        {"device_type": {"model": "ISR4321", "manufacturer": {"name": "Cisco", "tags": [{"name": "m"}]},
                         "part_number": "xyz123", "tags": [{"name": "t"}]}}])
    got = changes_by_position(result)
    kind = {"model": "undefined", "slug": "undefined", "manufacturer": UNDEFINED}
    role, place = {**UNDEFINED, "color": "000000"}, {**UNDEFINED, "status": "active"}
    assert got[0] == [
        ("create", "dcim.site", place), ("create", "dcim.manufacturer", UNDEFINED), ("create", "dcim.devicetype", kind),
        ("create", "dcim.devicerole", role),
        ("create", "dcim.device", {"name": "router01", "site": place, "device_type": kind, "role": role,
                                   "status": "active"})]
    assert got[1] == [("create", "dcim.site", {"name": "Site A", "slug": "site-a", "status": "active"})]
    last = len(BLANK) + 2
    assert set(got) == {0, 1, last}
    assert [(o, d.get("name", d.get("model"))) for _, o, d in got[last]] == [
        ("extras.tag", "t"), ("extras.tag", "m"), ("dcim.manufacturer", "Cisco"), ("dcim.devicetype", "ISR4321")]
    assert got[last][-1][2]["manufacturer"] == {"name": "Cisco", "slug": "cisco"}
    log = {r["error"]["message"] if r["error"] else r["state"]: r for r in result.log.collect()}
    assert set(log) == {"RECONCILED", "failed to prepare change set: invalid ingest entity"}
    assert log["failed to prepare change set: invalid ingest entity"]["error"]["code"] == 0
    errors = result.rejects.first()["errors"]
    assert len(errors) == len(BLANK) and errors[-1] == f"entity at index {len(BLANK) + 1} is nil"


def test_new_address_brings_everything_below_it(spark):
    got = changes_by_position(run(spark, [
        {"ip_address": {"address": "10.0.0.1/8", "tags": [{"name": "a"}],
                        "interface": {"name": "eth0", "tags": [{"name": "b"}]}}},
        {"virtual_disk": {"name": "disk", "size": 5, "virtual_machine": {"name": ""}}},
        {"vminterface": {"name": "nic", "virtual_machine": {"name": "vm", "cluster": {"name": ""}, "tags": [{"name": "a"}]}}},
    ]))
    assert [(o, d.get("name", d.get("model", d.get("address")))) for _, o, d in got[0]] == [
        ("extras.tag", "a"), ("extras.tag", "b"), ("dcim.site", "undefined"), ("dcim.platform", "undefined"),
        ("dcim.manufacturer", "undefined"), ("dcim.devicetype", "undefined"), ("dcim.devicerole", "undefined"),
        ("dcim.device", "undefined"), ("dcim.interface", "eth0"), ("ipam.ipaddress", "10.0.0.1/8")]
    address = got[0][-1][2]
    assert address["assigned_object"]["interface"]["device"]["platform"] == UNDEFINED
    assert "tags" not in address["assigned_object"]["interface"]
    assert [(c, o) for c, o, _ in got[1]] == [
        ("create", "virtualization.virtualmachine"), ("create", "virtualization.virtualdisk")]
    assert got[1][1][2]["size"] == 5
    assert [(c, o) for c, o, _ in got[2]] == [
        ("create", "virtualization.clustertype"), ("create", "virtualization.clustergroup"),
        ("create", "virtualization.cluster"), ("create", "virtualization.virtualmachine"),
        ("create", "virtualization.vminterface")]
    # The tag exists since the first entity.
    assert got[2][3][2]["tags"][0]["id"] > 0


def test_placeholder_site_forces_its_status(spark):
    retired = {**SITE_U, "status": "retired"}
    got = changes_of(run(spark, [{"prefix": {"prefix": "10.0.0.0/8"}}], [
        ("dcim.site", "undefined", retired),
        ("ipam.prefix", "10.0.0.0/8", {"id": 4, "prefix": "10.0.0.0/8", "site": retired, "status": "active"})]))
    assert got == [("update", "dcim.site", SITE_U),
                   ("update", "ipam.prefix", {"id": 4, "prefix": "10.0.0.0/8", "site": SITE_U, "status": "active"})]
