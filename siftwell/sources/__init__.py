"""Upload validation, the CSV source, stored tables, exports and synthetic data."""
