"""Table operators: rows, group-by and cross-tab, distribution statistics and bins."""
