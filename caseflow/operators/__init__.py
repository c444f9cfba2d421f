"""caseflow.operators."""
