"""The object types and their rules, as data. A new type is a new entry.

A *slot* is a place an object can take in the tree of one root entity. Every root type uses a
subset of the same seventeen slots, so one projection flattens every entity.
"""

from __future__ import annotations

from dataclasses import dataclass, field

SEPARATOR = "\x1f"
UNDEFINED = "undefined"
TAG_TYPE = "extras.tag"

# column -> (SQL type, name in the payload). A column has one meaning for every type that has it.
SCALARS: dict[str, tuple[str, str]] = {
    "status": ("string", "status"),
    "facility": ("string", "facility"),
    "time_zone": ("string", "time_zone"),
    "description": ("string", "description"),
    "comments": ("string", "comments"),
    "color": ("string", "color"),
    "serial": ("string", "serial"),
    "asset_tag": ("string", "asset_tag"),
    "part_number": ("string", "part_number"),
    "label": ("string", "label"),
    "interface_type": ("string", "type"),
    "enabled": ("boolean", "enabled"),
    "mtu": ("bigint", "mtu"),
    "mac_address": ("string", "mac_address"),
    "speed": ("bigint", "speed"),
    "wwn": ("string", "wwn"),
    "mgmt_only": ("boolean", "mgmt_only"),
    "mark_connected": ("boolean", "mark_connected"),
    "mode": ("string", "mode"),
    "address_role": ("string", "role"),
    "dns_name": ("string", "dns_name"),
    "is_pool": ("boolean", "is_pool"),
    "mark_utilized": ("boolean", "mark_utilized"),
    "vcpus": ("bigint", "vcpus"),
    "memory": ("bigint", "memory"),
    "disk": ("bigint", "disk"),
    "size": ("bigint", "size"),
}

# An empty text in these columns means "not observed".
EMPTY_IS_ABSENT = ("status", "color", "interface_type", "mode", "address_role")

REFERENCES = (
    "site", "manufacturer", "platform", "device_type", "role", "device", "interface",
    "group", "type", "cluster", "virtual_machine",
)


@dataclass(frozen=True)
class ObjectType:
    name: str
    entity: str
    scalars: tuple[str, ...]
    name_field: str = "name"
    slug: bool = False
    references: tuple[str, ...] = ()
    not_carried: tuple[str, ...] = ()
    defaults: dict[str, str] = field(default_factory=dict)
    placeholder: dict[str, str] = field(default_factory=dict)
    dedup: bool = False


_TYPES = (
    ObjectType("dcim.manufacturer", "manufacturer", ("description",), slug=True),
    ObjectType("dcim.platform", "platform", ("description",), slug=True, references=("manufacturer",)),
    ObjectType("dcim.devicerole", "device_role", ("color", "description"), slug=True,
               defaults={"color": "000000"}),
    ObjectType("dcim.devicetype", "device_type", ("description", "comments", "part_number"),
               name_field="model", slug=True, references=("manufacturer",)),
    ObjectType("dcim.site", "site", ("status", "facility", "time_zone", "description", "comments"),
               slug=True, defaults={"status": "active"}, placeholder={"status": "active"}),
    ObjectType("dcim.device", "device", ("status", "description", "comments", "asset_tag", "serial"),
               references=("site", "platform", "device_type", "role"),
               defaults={"status": "active"}, placeholder={"status": "active"}, dedup=True),
    ObjectType("dcim.interface", "interface",
               ("label", "interface_type", "enabled", "mtu", "mac_address", "speed", "wwn",
                "mgmt_only", "description", "mark_connected", "mode"),
               references=("device",), defaults={"interface_type": "other"}),
    ObjectType("ipam.ipaddress", "ip_address",
               ("status", "address_role", "dns_name", "description", "comments"),
               name_field="address", references=("interface",), defaults={"status": "active"}),
    ObjectType("ipam.prefix", "prefix",
               ("status", "is_pool", "mark_utilized", "description", "comments"),
               name_field="prefix", references=("site",), not_carried=("is_pool", "mark_utilized"),
               defaults={"status": "active"}),
    ObjectType("virtualization.clustergroup", "cluster_group", ("description",), slug=True),
    ObjectType("virtualization.clustertype", "cluster_type", ("description",), slug=True),
    ObjectType("virtualization.cluster", "cluster", ("status", "description"),
               references=("site", "type", "group"), not_carried=("status",),
               defaults={"status": "active"}, placeholder={"status": "active"}, dedup=True),
    ObjectType("virtualization.virtualmachine", "virtual_machine",
               ("status", "vcpus", "memory", "disk", "comments", "description"),
               references=("site", "cluster", "role", "platform"),
               defaults={"status": "active"}, placeholder={"status": "active"}, dedup=True),
    ObjectType("virtualization.vminterface", "vminterface",
               ("enabled", "mtu", "mac_address", "description"), references=("virtual_machine",)),
    ObjectType("virtualization.virtualdisk", "virtual_disk", ("size", "description"),
               references=("virtual_machine",), not_carried=("size",)),
)
TYPES: dict[str, ObjectType] = {t.name: t for t in _TYPES}
BY_ENTITY: dict[str, ObjectType] = {t.entity: t for t in _TYPES}

# Field of the observed struct, where it is not the column's own name.
SOURCE_FIELD = {"interface_type": "type", "address_role": "role"}


@dataclass(frozen=True)
class Slot:
    name: str
    type: ObjectType
    parents: dict[str, str] = field(default_factory=dict)  # reference -> slot


def _slot(name: str, type_name: str, **parents: str) -> Slot:
    return Slot(name, TYPES[type_name], parents)


# Children of a slot come before it, so one pass over the list goes from the leaves to the root.
_SLOTS = (
    _slot("manufacturer", "dcim.manufacturer"),
    _slot("platform_manufacturer", "dcim.manufacturer"),
    _slot("site", "dcim.site"),
    _slot("cluster_site", "dcim.site"),
    _slot("role", "dcim.devicerole"),
    _slot("cluster_group", "virtualization.clustergroup"),
    _slot("cluster_type", "virtualization.clustertype"),
    _slot("platform", "dcim.platform", manufacturer="platform_manufacturer"),
    _slot("device_type", "dcim.devicetype", manufacturer="manufacturer"),
    _slot("prefix", "ipam.prefix", site="site"),
    _slot("cluster", "virtualization.cluster", site="cluster_site", type="cluster_type",
          group="cluster_group"),
    _slot("device", "dcim.device", site="site", platform="platform", device_type="device_type",
          role="role"),
    _slot("vm", "virtualization.virtualmachine", site="site", cluster="cluster", role="role",
          platform="platform"),
    _slot("interface", "dcim.interface", device="device"),
    _slot("vm_interface", "virtualization.vminterface", virtual_machine="vm"),
    _slot("virtual_disk", "virtualization.virtualdisk", virtual_machine="vm"),
    _slot("ip_address", "ipam.ipaddress", interface="interface"),
)
SLOTS: dict[str, Slot] = {s.name: s for s in _SLOTS}
#: Slot of the root itself, where it is not named like the entity.
_ROOT_SLOT = {"device_role": "role", "virtual_machine": "vm", "vminterface": "vm_interface"}


@dataclass(frozen=True)
class Shape:
    """The slots the roots of a batch can fill, and the columns those need: a batch of sites is planned without
    the columns, look-ups and steps of machines. The result is the same for any shape that covers the batch."""

    slots: tuple[str, ...]

    @property
    def types(self) -> dict[str, ObjectType]:
        return {name: t for name, t in TYPES.items() if any(SLOTS[s].type is t for s in self.slots)}

    @property
    def scalars(self) -> tuple[str, ...]:
        return tuple(c for c in SCALARS if any(c in t.scalars for t in self.types.values()))

    @property
    def references(self) -> tuple[str, ...]:
        return tuple(r for r in REFERENCES if any(r in SLOTS[s].parents for s in self.slots))


def shape_of(type_names) -> Shape:
    """The shape of roots of these types: their slots and all slots below."""
    todo = [_ROOT_SLOT.get(TYPES[n].entity, TYPES[n].entity) for n in type_names if n in TYPES]
    found = set()
    while todo:
        slot = todo.pop()
        found.add(slot)
        todo += [p for p in SLOTS[slot].parents.values() if p not in found]
    return Shape(tuple(s for s in SLOTS if s in found))


ALL = Shape(tuple(SLOTS))

# Objects of these slots are outside the trees whose changes are made unique by content.
NOT_DEDUPED = ("interface", "ip_address", "vm_interface", "virtual_disk")

INTERFACE_MODES = ("access", "tagged", "tagged-all")
IP_STATUSES = ("active", "reserved", "deprecated", "dhcp", "slaac")
IP_ROLES = ("loopback", "secondary", "anycast", "vip", "vrrp", "hsrp", "glbp", "carp")
PREFIX_STATUSES = ("active", "container", "reserved", "deprecated")
SITE_STATUSES = ("planned", "staging", "active", "decommissioning", "retired")
DEVICE_STATUSES = ("offline", "active", "planned", "staged", "failed", "inventory", "decommissioning")
VIRTUALIZATION_STATUSES = ("offline", "active", "planned", "staged", "failed", "decommissioning")

# The interface types the inventory accepts.
INTERFACE_TYPES = tuple("""
virtual bridge lag
100base-fx 100base-lfx 100base-tx 100base-t1
1000base-t 1000base-x-gbic 1000base-x-sfp 2.5gbase-t 5gbase-t
10gbase-t 10gbase-cx4 10gbase-x-sfpp 10gbase-x-xfp 10gbase-x-xenpak 10gbase-x-x2
25gbase-x-sfp28 50gbase-x-sfp56 40gbase-x-qsfpp 50gbase-x-sfp28
100gbase-x-cfp 100gbase-x-cfp2 100gbase-x-cfp4 100gbase-x-cxp 100gbase-x-cpak
100gbase-x-dsfp 100gbase-x-sfpdd 100gbase-x-qsfp28 100gbase-x-qsfpdd
200gbase-x-cfp2 200gbase-x-qsfp56 200gbase-x-qsfpdd
400gbase-x-cfp2 400gbase-x-qsfp112 400gbase-x-qsfpdd 400gbase-x-osfp 400gbase-x-osfp-rhs
400gbase-x-cdfp 400gbase-x-cfp8 800gbase-x-qsfpdd 800gbase-x-osfp
1000base-kx 10gbase-kr 10gbase-kx4 25gbase-kr 40gbase-kr4 50gbase-kr
100gbase-kp4 100gbase-kr2 100gbase-kr4
ieee802.11a ieee802.11g ieee802.11n ieee802.11ac ieee802.11ad ieee802.11ax ieee802.11ay
ieee802.15.1 other-wireless gsm cdma lte
sonet-oc3 sonet-oc12 sonet-oc48 sonet-oc192 sonet-oc768 sonet-oc1920 sonet-oc3840
1gfc-sfp 2gfc-sfp 4gfc-sfp 8gfc-sfpp 16gfc-sfpp 32gfc-sfp28 64gfc-qsfpp 128gfc-qsfp28
infiniband-sdr infiniband-ddr infiniband-qdr infiniband-fdr10 infiniband-fdr
infiniband-edr infiniband-hdr infiniband-ndr infiniband-xdr
t1 e1 t3 e3 xdsl docsis
gpon xg-pon xgs-pon ng-pon2 epon 10g-epon
cisco-stackwise cisco-stackwise-plus cisco-flexstack cisco-flexstack-plus
cisco-stackwise-80 cisco-stackwise-160 cisco-stackwise-320 cisco-stackwise-480 cisco-stackwise-1t
juniper-vcp extreme-summitstack extreme-summitstack-128 extreme-summitstack-256
extreme-summitstack-512 other
""".split())
