"""Building blocks: joins, per-key picks, ordered running values, state changes and checks."""
