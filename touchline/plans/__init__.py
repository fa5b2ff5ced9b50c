"""End-to-end jobs: the marts and the page-level query sets."""
