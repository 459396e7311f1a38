"""sources of the price catalogue engine."""
