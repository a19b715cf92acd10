"""Table readers, derived domain tables and sinks."""
