"""Column expressions: typed parsing, deterministic ids, literals for time."""
