"""Column functions: request coercion, stock arithmetic, text clean-up."""
