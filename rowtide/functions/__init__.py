"""Functions of the ordered-table engine."""
