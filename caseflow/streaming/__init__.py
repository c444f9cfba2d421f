"""caseflow.streaming."""
