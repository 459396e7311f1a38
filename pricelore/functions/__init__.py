"""functions of the price catalogue engine."""
