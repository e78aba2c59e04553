"""Reports, marts and the named query catalogue built from the operators."""
