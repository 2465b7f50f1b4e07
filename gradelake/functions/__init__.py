"""Part of the academic-results engine."""
