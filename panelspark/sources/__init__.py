"""Sources and sinks: JDBC extracts, landing of raw tables, incremental merges and a factor registry."""
