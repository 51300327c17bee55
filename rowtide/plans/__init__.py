"""Plans of the ordered-table engine."""
