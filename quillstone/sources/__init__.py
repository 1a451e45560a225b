"""Sources and sinks: tables of Parquet parts, CSV loading, media files."""
