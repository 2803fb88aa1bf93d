"""Readers and writers of run records, audit reports, thresholds and meshes."""
