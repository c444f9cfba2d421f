"""caseflow.plans."""
