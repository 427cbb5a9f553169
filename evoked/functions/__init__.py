"""Column functions: labels, names, metrics, tails."""
