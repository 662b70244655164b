"""Sources and sinks: driver tables, CSV flow files, alert logs, metrics, models."""
