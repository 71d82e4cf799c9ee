"""Readers and writers of the linkage files: tab-separated records, id lists, Parquet artifacts with provenance, reports."""
