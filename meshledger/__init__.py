"""Inventory reconciliation as Spark jobs: observations in, change sets, state and log out."""
