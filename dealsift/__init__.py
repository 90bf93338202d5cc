"""dealsift: ranked, deduplicated opportunity tables from captured listings, on Spark."""
