"""Operators over meshes, topology, entities, size fields and run records; all take and return DataFrames."""
