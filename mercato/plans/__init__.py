"""Reports and feature sets built from the operators."""
