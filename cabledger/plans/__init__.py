"""Reports and settlement jobs, each a function from tables to new tables."""
