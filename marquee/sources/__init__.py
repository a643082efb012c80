"""Sources and sinks: parquet tables, raw TSV dumps, change manifests,
snapshot versions and append-only sinks."""
