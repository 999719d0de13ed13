"""End-to-end jobs that read tables, compose operators and write tables."""
