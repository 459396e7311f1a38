"""operators of the price catalogue engine."""
