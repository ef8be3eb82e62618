"""Sources and sinks: log discovery, line scan with line numbers, whole-document
unwrap, ingest + manifest, the events store, and case-file documents."""
