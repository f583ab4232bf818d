"""Logical plans: SQL templates over named inputs, and the registry of queries."""
