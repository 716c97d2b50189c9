"""Sources and sinks: append-only record files."""
