"""Reports built from several operators."""
