"""caseflow.sources."""
