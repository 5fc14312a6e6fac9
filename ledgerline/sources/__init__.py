"""Sources: CSV file scan, driver tables, synthetic generator."""
