"""Spark schemas of the ingest request and of the tables the jobs exchange."""

from __future__ import annotations

from pyspark.sql import types as T

STRING, BOOL, INT, LONG = T.StringType(), T.BooleanType(), T.IntegerType(), T.LongType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


TAG = _struct(name=STRING, slug=STRING, color=STRING)
TAGS = T.ArrayType(TAG)
STORED_TAG = _struct(id=LONG, name=STRING, slug=STRING, color=STRING)

SITE = _struct(
    name=STRING, slug=STRING, status=STRING, facility=STRING, time_zone=STRING,
    description=STRING, comments=STRING, tags=TAGS,
)
MANUFACTURER = _struct(name=STRING, slug=STRING, description=STRING, tags=TAGS)
PLATFORM = _struct(name=STRING, slug=STRING, manufacturer=MANUFACTURER, description=STRING, tags=TAGS)
ROLE = _struct(name=STRING, slug=STRING, color=STRING, description=STRING, tags=TAGS)
DEVICE_TYPE = _struct(
    model=STRING, slug=STRING, manufacturer=MANUFACTURER, description=STRING,
    comments=STRING, part_number=STRING, tags=TAGS,
)
# A primary address is a whole address, but for the interface, which leads back to its holder.
PRIMARY_IP = _struct(address=STRING, status=STRING, role=STRING, dns_name=STRING, description=STRING, comments=STRING, tags=TAGS)
DEVICE = _struct(
    name=STRING, device_fqdn=STRING, device_type=DEVICE_TYPE, role=ROLE, platform=PLATFORM,
    serial=STRING, site=SITE, asset_tag=STRING, status=STRING, description=STRING,
    comments=STRING, tags=TAGS, primary_ip4=PRIMARY_IP, primary_ip6=PRIMARY_IP,
)
INTERFACE = _struct(
    device=DEVICE, name=STRING, label=STRING, type=STRING, enabled=BOOL, mtu=INT,
    mac_address=STRING, speed=INT, wwn=STRING, mgmt_only=BOOL, description=STRING,
    mark_connected=BOOL, mode=STRING, tags=TAGS,
)
IP_ADDRESS = _struct(
    address=STRING, interface=INTERFACE, status=STRING, role=STRING, dns_name=STRING,
    description=STRING, comments=STRING, tags=TAGS,
)
PREFIX = _struct(
    prefix=STRING, site=SITE, status=STRING, is_pool=BOOL, mark_utilized=BOOL,
    description=STRING, comments=STRING, tags=TAGS,
)
CLUSTER_GROUP = _struct(name=STRING, slug=STRING, description=STRING, tags=TAGS)
CLUSTER_TYPE = CLUSTER_GROUP
CLUSTER = _struct(
    name=STRING, type=CLUSTER_TYPE, group=CLUSTER_GROUP, site=SITE, status=STRING,
    description=STRING, tags=TAGS,
)
VIRTUAL_MACHINE = _struct(
    name=STRING, status=STRING, site=SITE, cluster=CLUSTER, role=ROLE, device=DEVICE,
    platform=PLATFORM, primary_ip4=PRIMARY_IP, primary_ip6=PRIMARY_IP, vcpus=INT, memory=INT,
    disk=INT, description=STRING, comments=STRING, tags=TAGS,
)
VM_INTERFACE = _struct(
    virtual_machine=VIRTUAL_MACHINE, name=STRING, enabled=BOOL, mtu=INT, mac_address=STRING,
    description=STRING, tags=TAGS,
)
VIRTUAL_DISK = _struct(
    virtual_machine=VIRTUAL_MACHINE, name=STRING, size=INT, description=STRING, tags=TAGS,
)

ENTITY = _struct(
    site=SITE, platform=PLATFORM, manufacturer=MANUFACTURER, device=DEVICE, device_role=ROLE,
    device_type=DEVICE_TYPE, interface=INTERFACE, ip_address=IP_ADDRESS, prefix=PREFIX,
    cluster_group=CLUSTER_GROUP, cluster_type=CLUSTER_TYPE, cluster=CLUSTER,
    virtual_machine=VIRTUAL_MACHINE, vminterface=VM_INTERFACE, virtual_disk=VIRTUAL_DISK,
    timestamp=T.TimestampType(),
)

REQUEST = _struct(
    stream=STRING, id=STRING, producer_app_name=STRING, producer_app_version=STRING,
    sdk_name=STRING, sdk_version=STRING, entities=T.ArrayType(ENTITY), ingestion_ts=LONG,
)

# One message of the stream: the request as JSON text and the arrival time as text.
MESSAGE = _struct(request=STRING, ingestion_ts=STRING)

APPLY_RESPONSE = _struct(
    change_set_id=STRING, code=INT, message=STRING, result=STRING,
    errors=T.ArrayType(T.MapType(STRING, STRING)),
)
ERROR = _struct(
    message=STRING, code=INT,
    details=_struct(
        change_set_id=STRING, result=STRING,
        errors=T.ArrayType(_struct(error=STRING, change_id=STRING)),
    ),
)
CHANGE = _struct(
    ord=INT, change_id=STRING, change_type=STRING, object_type=STRING, object_id=LONG, object_version=LONG, data=STRING,
)
LOG = _struct(
    id=STRING, data_type=STRING, state=STRING, request_id=STRING, ingestion_ts=LONG,
    producer_app_name=STRING, producer_app_version=STRING, sdk_name=STRING, sdk_version=STRING,
    entity=STRING, error=ERROR, change_set_id=STRING, change_set=T.ArrayType(CHANGE),
)
