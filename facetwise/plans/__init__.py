"""Queries over the driver's tables: bindings of operators to them, and SQL that must agree."""
