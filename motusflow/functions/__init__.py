"""Column expressions: paths, time stamps, vectors, label rules."""
