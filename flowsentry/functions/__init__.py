"""Column expressions: labels, cleaning, scaling, thresholds, fusion, hashing."""
