"""DataFrame to DataFrame operators, one module a family."""
