"""Sources and sinks: test-data tables, lead CSV files, chunk store, model store."""
