"""DataFrame operators: resolution, extraction, validation, merge, analytics."""
