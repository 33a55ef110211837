"""End-to-end jobs: train a table, score a table."""
