"""Per-column cleaners, profiling, rules, feedback and statistics."""
