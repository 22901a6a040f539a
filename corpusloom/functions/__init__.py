"""Column builders: hashes, paths, text measures and ranks, all as built-in expressions."""
