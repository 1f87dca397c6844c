"""Column-level functions: sequence expressions, text parsing, distribution tails."""
