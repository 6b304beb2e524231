"""Operators over the catalog: DML, dedup, lifecycle, maintenance, backup, cluster."""
