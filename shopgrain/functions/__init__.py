"""Column expressions, distributed order statistics and distribution tails."""
