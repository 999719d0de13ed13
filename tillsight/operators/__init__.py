"""DataFrame operators: clean, de-duplicate, aggregate, join, report, merge."""
