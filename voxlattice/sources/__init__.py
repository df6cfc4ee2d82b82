"""Sources and sinks: JSON documents, Parquet tables, generators, derived views."""
