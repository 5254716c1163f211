"""Column-level building blocks: hashing, vector maths, scalar statistics, names."""
