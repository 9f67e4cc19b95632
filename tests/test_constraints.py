"""Constraints of objects nested in devices and machines."""

from __future__ import annotations

import duckdb

from meshledger.catalog import REGISTRY
from meshledger.operators.validate import nested_objects

SF = "/root/testdata/sf0.01"


def test_machines_hold_devices_and_addresses():
    for path in ("virtual_machine.device", "virtual_machine.primary_ip4", "virtual_machine.primary_ip6",
                 "virtual_machine.device.primary_ip6"):
        assert path in dict(nested_objects("virtual_machine")) and f"virtual_disk.{path}" in dict(nested_objects("virtual_disk"))


def test_machine_violations_equal_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW supplier AS SELECT * FROM '{SF}/supplier.parquet'")
    function, sql = REGISTRY["constraint_violations_machines"]
    got = function(spark, SF).select("s_suppkey", "violations").collect()
    assert sorted(tuple(r) for r in got) == sorted(db.execute(
        f"SELECT s_suppkey, violations FROM ({sql})").fetchall())
    assert any("virtual_disk.virtual_machine.device" in r.violations for r in got)
