"""Table readers and the old-state + delta -> new-state sinks."""
