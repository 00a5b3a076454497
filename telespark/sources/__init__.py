"""Sources and sinks: driver tables, the telemetry adapter, CSV logs, Parquet."""
