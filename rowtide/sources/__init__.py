"""Sources of the ordered-table engine."""
